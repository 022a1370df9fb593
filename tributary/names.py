"""Names of effects, strata, labels, policies and worlds."""

E_RERANK, E_GATE, DELTA_T = "e_rerank", "e_gate", "delta_t"
EFFECTS = (E_RERANK, E_GATE, DELTA_T)

SURVIVOR, NON_SURVIVOR = "survivor", "non_survivor"
RETAINED, REMOVED, SELECTED, UNSELECTED = "retained", "removed", "selected_outsider", "unselected_outsider"
STRATA = {E_RERANK: (SURVIVOR, NON_SURVIVOR), E_GATE: (SURVIVOR, NON_SURVIVOR), DELTA_T: (RETAINED, REMOVED, SELECTED, UNSELECTED)}
#: Strata whose magnitudes carry information, and those that are zero by construction.
INFORMATIVE = {E_RERANK: (SURVIVOR,), E_GATE: (SURVIVOR, NON_SURVIVOR), DELTA_T: (RETAINED, REMOVED, SELECTED)}
STRUCTURAL_ZERO = {E_RERANK: (NON_SURVIVOR,), E_GATE: (), DELTA_T: (UNSELECTED,)}

GATE_SENSITIVE, RERANK_SENSITIVE, MIXED = "gate_sensitive", "rerank_sensitive", "mixed_stable"
JOINT, STABLE, GATING_FAILURE = "jointly_sensitive", "stable", "gating_failure"

BOUNDARY, ALTERNATIVE, RANDOM = "boundary", "alternative", "random"
POLICIES = (BOUNDARY, ALTERNATIVE, RANDOM)

#: Tolerances: contracts and labels, and the finer one of outsider and probe reports.
EPS, FINE_EPS = 1e-9, 1e-12
UNRANKED = 1 << 30
