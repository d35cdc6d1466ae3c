"""Fixed values.

Everything in this module is a constant of the data model: word lists, weights,
thresholds and patterns that results depend on.  They are stated here once and
used by both the column functions and the tests.
"""

# --- fixed values: fact kinds and their scoring shapes -----------------------
SHAPE_OF_KIND = {
    "user_fact": "episodic_fact",
    "project_fact": "episodic_fact",
    "feedback": "episodic_fact",
    "reference": "episodic_fact",
    "preference": "preference",
    "prohibition": "preference",
    "procedure": "procedure",
    "narrative": "narrative",
}
NON_PERSISTENT = ("reply_only", "peer_route", "drop", "escalate")

TYPE_PRIORITY = {
    "prohibition": 1.00,
    "preference": 0.85,
    "user_fact": 0.70,
    "feedback": 0.55,
    "procedure": 0.55,
    "narrative": 0.50,
    "project_fact": 0.40,
    "reference": 0.25,
}
DEFAULT_TYPE_PRIORITY = 0.30

# shape -> (recency time constant in days, recency weight, contradiction cap)
SHAPE_PARAMS = {
    "episodic_fact": (30.0, 0.30, 0.50),
    "preference": (30.0, 0.00, 0.30),
    "procedure": (180.0, 0.30, 0.50),
    "narrative": (30.0, 0.00, 0.50),
}

# --- fixed values: score weights and thresholds ------------------------------
ALPHA, GAMMA, DELTA, EPS = 0.2, 0.2, 0.4, 0.5
R_INF = 0.05
G_FLOOR = 0.5
THETA_DEMOTE = 0.20
THETA_PROMOTE = 0.70

# --- fixed values: retrieval --------------------------------------------------
RRF_K = 60
FANOUT = 50
SOURCE_PRIORITY = {"semantic": 0, "lexical": 1, "graph": 2}
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6
RANK_DIGITS = 9  # scores are rounded to this before ranking, so ties are stable

# --- fixed values: recall-time rerank ----------------------------------------
W_INTENT = 0.15
INTENT_MATCH = {
    "update_preference": {"prohibition": 0.5, "preference": 1.0, "user_fact": 0.3, "procedure": 0.0, "narrative": 0.0},
    "state_fact": {"prohibition": 0.3, "preference": 0.3, "user_fact": 1.0, "procedure": 0.0, "narrative": 0.0},
    "procedure_lookup": {"prohibition": 0.5, "preference": 0.0, "user_fact": 0.0, "procedure": 1.0, "narrative": 0.0},
    "narrative_recall": {"prohibition": 0.0, "preference": 0.0, "user_fact": 0.3, "procedure": 0.0, "narrative": 1.0},
}
W_UTILITY_MAX, W_UTILITY_FROM, W_UTILITY_SPAN = 0.2, 1000, 9000

# --- fixed values: utility ledger --------------------------------------------
UTILITY_WEIGHTS = {
    "citation": 0.4,
    "tool_success": 0.7,
    "correction": 1.0,
    "repeat_recall": 0.1,
    "no_op": -0.2,
}
UTILITY_TAU_DAYS = 30.0

# --- fixed values: graph -------------------------------------------------------
PPR_DAMPING, PPR_MAX_ITER, PPR_TOL = 0.85, 50, 1e-6
EGO_CAP = 500
DEGREE_FALLBACK_BELOW = 10
PPR_DIGITS = 12

# --- fixed values: lifecycle ----------------------------------------------------
PURGE_GRACE_DAYS = 90
MINORITY_RETENTION_DAYS = 90
PREFERENCES_CAP_BYTES = 10240
IDEMPOTENCY_TTL_HOURS = 24
REVIEW_TTL_DAYS = 7
GATE_SECONDS, LOCK_BREAK_SECONDS = 900, 60
INBOX_CAP, INBOX_TTL_DAYS = 100, 7
REGEN_PAGES_PER_CYCLE = 100
CITATION_COSINE = 0.82
COVERING_TIERS = ("demoted", "invalidated", "backfilled")
PROMOTE_DECISIONS = ("score_above_theta_promote",)
DEMOTE_DECISIONS = ("score_below_theta_demote", "score_below_theta_purge")
INVALIDATE_REASONS = ("contradiction_detected", "score_below_floor", "superseded", "manual_correction")
PHASES = ("extract", "score", "promote", "demote", "consolidate", "invalidate")

# --- fixed values: intent classification ---------------------------------------
INTENTS = (
    "drop",
    "reply_only",
    "peer_route",
    "escalate",
    "remember:fact",
    "remember:preference",
    "remember:procedure",
)
RETENTION_OF_INTENT = {
    "remember:fact": "episodic_fact",
    "remember:preference": "preference",
    "remember:procedure": "procedure",
}
SHORT_UTTERANCE = 16
DECISION_CONFIDENCE = 0.8
# (?U) makes \d, \b and \s Unicode-aware in Java regular expressions
SENSITIVE_DIGITS = r"(?U)\d{9,}"
SENSITIVE_KEYS = r"(?U)\b(sk-|ghp_|gho_|ghs_|xoxb-|xoxp-|AKIA)[A-Za-z0-9]{8,}\b"
SENSITIVE_WORDS = (
    r"(?iU)\b(password|passwd|secret|api[_\- ]?key|private[_\- ]?key|"
    r"ssn|social[_\- ]?security|credit[_\- ]?card)\b"
)
SENSITIVE_KEY_STEMS = ("sk-", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "AKIA")
SENSITIVE_WORD_STEMS = ("passw", "secret", "api", "private", "ssn", "social", "credit")
DIGIT_OR_NAME = r"(?U)\d|\b[A-Z][a-z]+"
UUID7 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"

# --- fixed values: event envelopes ----------------------------------------------
EVENT_COMMON = (
    "event_id",
    "event_type",
    "tenant_id",
    "ts_recorded",
    "ts_valid",
    "model_version",
    "weights_version",
    "contamination_protected",
)
EVENT_REQUIRED = {
    "remember": ("fact_ids", "decision", "provenance"),
    "recall": ("recall_id", "fact_ids", "path"),
    "recall_outcome": (),
    "promote": ("fact_ids", "decision", "score_output"),
    "demote": ("fact_ids", "decision", "score_output"),
    "invalidate": ("fact_ids", "decision", "superseded_by"),
    "consolidate_phase": ("phase_name", "consolidate_run_id"),
}
RECALL_PATHS = ("recall", "synthesis")
INGEST_VERSIONS = ("p2-classifier-v0", "p2-weights-v0")
TRANSITION_VERSIONS = ("v1.0.0", "p4-default-weights")

# --- fixed values: evaluation-set composition -------------------------------------
# epoch -> source class -> (floor share, cap share)
COMPOSITION = {
    "v1.0": {
        "operator": (0.0, 0.0),
        "adversarial": (0.30, 1.0),
        "ablation": (0.25, 1.0),
        "synthetic": (0.0, 0.25),
        "author": (0.0, 0.15),
    },
    "v1.x": {"operator": (0.20, 1.0), "author": (0.0, 0.10)},
}
SYMMETRY_RANGE = (0.7, 1.3)
STRICT_SOURCES = ("operator", "adversarial", "ablation", "replay-only")
