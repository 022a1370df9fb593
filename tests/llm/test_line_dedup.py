from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import frame
from tributary.llm import line_dedup as L
from tributary.llm import queries


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
@settings(max_examples=300, deadline=None)
def test_patience_blocks_are_common_and_in_order(a, b):
    last_a = last_b = 0
    for i, j, n in L.patience(a, b):
        assert n > 0 and i >= last_a and j >= last_b and a[i : i + n] == b[j : j + n]
        last_a, last_b = i + n, j + n


def test_patience_finds_whole_copies():
    assert L.patience([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert L.patience([1, 2, 3, 4, 5], [9, 2, 3, 7, 5]) == [(1, 1, 2), (4, 4, 1)]
    assert L.patience([], [1]) == []


def brute(rows, least=L.LEAST_CHARS, rare=L.RARE):
    """The same rules over plain dictionaries: owners, rare or doubled shared lines, patience diff."""
    texts = {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        texts.setdefault(t, d)
    lines = {d: t.split("\n") for t, d in texts.items()}
    holders = {}
    for d, ls in lines.items():
        for x in {x for x in ls if len(x.strip(" ")) >= least}:
            holders.setdefault(x, []).append(d)
    gone = {}
    for d, ls in lines.items():
        shared = {}
        for x in set(ls):
            if x in holders and min(holders[x]) < d:
                shared.setdefault(min(holders[x]), []).append(len(holders[x]))
        for owner, df in shared.items():
            if min(df) <= rare or len(df) > 1:
                gone.setdefault(d, set()).update(L.common_lines(lines[owner], ls, [len(x.strip(" ")) for x in ls], least))
    out = []
    for d, t in rows:
        if d is None or not t:
            out.append((d, t))
        elif texts[t] < d and sum(len(x.strip(" ")) for x in t.split("\n")) >= least:
            out.append((d, ""))
        else:
            out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(texts[t] if texts[t] == d else None, ()))))
    return sorted(out, key=str)


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_against_brute_force(spark, docs, small):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert texts_of(queries.op7_line_dedup(spark, small)) == brute(rows)


def test_edges(edge, edge_rows, nothing):
    out = L.line_dedup(edge)
    assert texts_of(out) == brute(edge_rows)
    assert set(edge.columns) <= set(out.columns)
    counts = {(r.doc_id, r.n_lines, r.n_removed) for r in out.select("doc_id", "n_lines", "n_removed").collect()}
    assert (3, 13, 12) in counts and (4, 0, 0) in counts and (1, 12, 0) in counts
    assert L.line_dedup(nothing).count() == 0


def test_boilerplate_alone_pairs_nothing(spark):
    notice = "This notice is on every page of the site and says nothing else."
    rows = [(i, f"the only line of its kind, number {i}, and long enough\n{notice}") for i in range(L.RARE + 5)]
    assert texts_of(L.line_dedup(frame(spark, rows))) == sorted(rows, key=str)
    assert sum(notice in t for _, t in texts_of(L.line_dedup(frame(spark, rows[: L.RARE])))) == 1


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([1, 20, 1 << 28]))
@settings(max_examples=300, deadline=None)
def test_longest_common_subsequence(a, b, bits):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    had, L.ROW_BITS = L.ROW_BITS, bits
    try:
        got = L.longest_common(a, b)
    finally:
        L.ROW_BITS = had
    assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_lines_that_recur_are_matched():
    assert L.common_lines([1, 7, 7, 8, 8, 2], [3, 7, 7, 8, 8, 4], [0, 20, 20, 20, 20, 0], 30) == [1, 2, 3, 4]


def test_passages_of_short_lines_are_removed(spark):
    verse = "\n".join(f"short line {c}" for c in "abcdef")
    rows = [(1, f"one text\n{verse}\nends here"), (2, f"other text\n{verse}\nhas an end"), (3, "short line a\nshort line b\nno more of it")]
    assert texts_of(L.line_dedup(frame(spark, rows))) == [rows[0], (2, "other text\nhas an end"), rows[2]]


def test_lines_that_one_document_repeats_count_once(spark):
    line = "This line is in two documents and one of them says it again and again."
    rows = [(1, f"first text of all\n{line}"), (2, "\n".join(["second text of all"] + [f"{line}\nbetween {i}" for i in range(11)]))]
    assert line not in dict(texts_of(L.line_dedup(frame(spark, rows))))[2].split("\n")[1:2]
    both = [(1, rows[0][1]), (2, f"{line}\nsecond text of all"), (3, "\n".join([line, "third text"] * 11))]
    assert dict(texts_of(L.line_dedup(frame(spark, both))))[2] == "second text of all"


def test_passages_go_however_common_they_are(spark):
    passage = " ".join(f"word{i} of a passage" for i in range(20))
    rows = [(i, f"the only line of its kind, number {i}, and long enough\n{passage}") for i in range(L.RARE + 5)]
    assert len(passage) >= L.PASSAGE_CHARS
    assert [passage in t for _, t in texts_of(L.line_dedup(frame(spark, rows)))].count(True) == 1


def test_passages_of_many_short_words_go_too(spark):
    passage, shorter = (" ".join(["so it is"] * 17)[:-n] if n else " ".join(["so it is"] * 17) for n in (0, 3))
    assert len(passage) < L.PASSAGE_CHARS and len(passage.split()) == L.PASSAGE_WORDS + 1 and len(shorter.split()) == L.PASSAGE_WORDS
    for text, left in ((passage, 1), (shorter, L.RARE + 5)):
        rows = [(i, f"the only line of its kind, number {i}, and long enough\n{text}") for i in range(L.RARE + 5)]
        assert sum(text in t.split("\n") for _, t in texts_of(L.line_dedup(frame(spark, rows)))) == left


def test_without_a_limit_common_lines_go_at_any_frequency(spark):
    notice = "This notice is on every page of the site and says nothing else."
    for n in (L.RARE, L.RARE + 1, L.RARE + 30):
        rows = [(i, f"the only line of its kind, number {i}, and long enough\n{notice}") for i in range(n)]
        out = dict(texts_of(L.line_dedup(frame(spark, rows), rare=None)))
        assert [i for i, t in out.items() if notice in t] == [0] and all(f"number {i}," in t for i, t in out.items())
