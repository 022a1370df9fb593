import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tributary.llm import quality_rules as Q


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)})


def brute(rows, most=Q.MOST_DOCS):
    """(doc_id, measures..., kept) of (doc_id, text, host) rows by plain dictionaries."""
    def plain(text):
        return [x for x in (re.sub("[0-9]+", "0", " ".join(split(line))).lower() for line in text.split("\n")) if x]

    holders = defaultdict(set)
    for d, t, h in rows:
        for x in plain(t or "") if d is not None else ():
            holders[h or "", x].add(d)
    out = []
    for d, t, h in rows:
        t = t or ""
        words, lines = split(t), [x for x in t.split("\n") if split(x)]
        again = repeats(words) if len(words) < 5000 else None
        failed = len(words) < 10 or 100 * (again or 0) > 20 * len(words)
        lost = sum(len(x.split(" ")) for x in plain(t) if len(own := holders[h or "", x]) > most and (d is None or d > min(own)))
        left = len(words) - lost
        out.append((d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, failed, not failed and left >= 10 and 2 * left >= len(words)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words if r.n_words < 5000 else None, r.base_failed, r.kept) for r in df.collect()), key=str)


def test_edges(edge, edge_rows, nothing):
    assert found(Q.apply_rules(edge)) == brute([(d, t, "s") for d, t in edge_rows])
    assert Q.apply_rules(nothing).count() == 0


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=8))
@settings(max_examples=4, deadline=None)
def test_repeated_windows(spark, words):
    rows = frame(spark, [(i, " ".join(w)) for i, w in enumerate(words)])
    assert [r.n_repeat_words for r in Q.apply_rules(rows).orderBy("doc_id").collect()] == [repeats(w) for w in words]


def test_common_lines_stay_in_their_first_document(spark):
    """Depletion is judged per host; numbers and case do not matter, and one document of many copies stays."""
    own = " ".join(f"own{{0}}word{i}" for i in range(12))
    notice = "Page {0} of the Terms that stand on each page of this host and are longer than what else it says"
    rows = [(i, f"{notice.format(i)}\n{own.format(i)}", "hot") for i in range(14)] + [(50 + i, f"{notice.format(i)}\n{own.format(i)}", "other") for i in range(10)]
    rows += [(100 + i, "\n".join(["a copy of many words that many documents have in common", "and a second line of it"]), "hot") for i in range(20)] + [(None, notice.format(7), "hot"), (3, notice.format(3) + " #", None)]
    docs = spark.createDataFrame([(d, t, h, 7) for d, t, h in rows], "doc_id long, text string, source string, row int").repartition(3)
    out = Q.apply_rules(docs)
    assert found(out) == brute(rows)
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert kept == {0, 100, 3, *range(50, 60)} or kept == {0, 100, *range(50, 60)}


def test_no_python_in_the_plan(docs):
    plan = Q.apply_rules(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_other_hosts(spark):
    docs = frame(spark, [(i, "a line of ten words that all of the documents share here") for i in range(12)]).withColumn("site", F.col("doc_id") % 2)
    assert Q.apply_rules(docs, host="site").where("kept").count() == 12 and Q.apply_rules(docs).where("kept").count() == 1
