"""Text functions: tokens, Unicode-aware strip, intent rules."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import blank, lookup

TOKEN = r"[\p{L}\p{N}]+"


def _accent_table() -> tuple[str, str]:
    """Latin letters that are one plain letter plus marks, and that plain letter."""
    src, dst = [], []
    for code in range(0x00C0, 0x0250):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            src.append(chr(code))
            dst.append(plain)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics on Latin letters."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, in text order with repeats."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of any Unicode class from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def sensitive(text: Column) -> Column:
    """Long numbers, credentials or sensitive words.

    The plain substring tests only spare most texts the slower patterns: no text can match a
    pattern without one of its stems.  The long s is a case variant of s to the pattern.
    """
    low = F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))
    return (
        text.rlike(v.SENSITIVE_DIGITS)
        | (_any_of(text, v.SENSITIVE_KEY_STEMS) & text.rlike(v.SENSITIVE_KEYS))
        | (_any_of(low, v.SENSITIVE_WORD_STEMS) & text.rlike(v.SENSITIVE_WORDS))
    )


def digit_or_name(text: Column) -> Column:
    return text.rlike(v.DIGIT_OR_NAME)


def _verdict(intent: str, confidence: float, rule: str) -> Column:
    return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))


def heuristic(payload: Column, source_kind: Column, source_subtype: Column) -> Column:
    """Ordered rules -> struct(intent, confidence, rule); below 0.8 the verdict is only a guess."""
    short = (source_kind == "utterance") & (F.length(strip(payload)) < v.SHORT_UTTERANCE) & ~digit_or_name(payload)
    sub = F.coalesce(source_subtype, F.lit(""))
    peer, tool = source_kind == "peer_message", source_kind == "tool_call_result"
    return (
        F.when(short, _verdict("drop", 0.95, "short_utterance"))
        .when(peer & (sub == "info"), _verdict("reply_only", 0.9, "peer_info"))
        .when(tool & (sub == "idempotent"), _verdict("remember:procedure", 0.9, "tool_idempotent"))
        .when(peer & (sub == "claim"), _verdict("remember:fact", 0.4, "peer_claim"))
        .when(tool, _verdict("reply_only", 0.5, "tool_other"))
        .otherwise(_verdict("remember:fact", 0.5, "utterance"))
    )


def classify(
    payload: Column,
    source_kind: Column,
    source_subtype: Column,
    caller_tag: Column | None = None,
    force_skip: Column | None = None,
    model_intent: Column | None = None,
    model_score: Column | None = None,
) -> Column:
    """Full dispatch -> struct(intent, confidence, path, detail).

    Order: forced tag, sensitive content, confident rule, model verdict (when there is
    one), caller tag, guess.  A forced tag is honoured before the sensitive test.
    """
    none = F.lit(None).cast("string")
    tag = none if caller_tag is None else caller_tag
    forced = F.lit(False) if force_skip is None else F.coalesce(force_skip, F.lit(False))
    m_intent = none if model_intent is None else model_intent
    m_score = F.lit(None).cast("double") if model_score is None else model_score
    h = heuristic(payload, source_kind, source_subtype)
    h_intent, h_conf = h.getField("intent"), h.getField("confidence")

    def out(intent, confidence, path, detail):
        return F.struct(
            intent.alias("intent"), confidence.alias("confidence"),
            F.lit(path).alias("path"), F.lit(detail).alias("detail"),
        )

    missing_tag = forced & tag.isNull()
    bad_model = m_intent.isNotNull() & (~m_intent.isin(*v.INTENTS) | ~F.coalesce(m_score.between(0.0, 1.0), F.lit(False)))
    overruled = tag.isNotNull() & (m_intent != tag) & (m_score < v.DECISION_CONFIDENCE)
    return (
        F.when(missing_tag, F.raise_error(F.lit("a forced classification needs a caller tag")))
        .when(forced, out(tag, F.lit(1.0), "caller_tagged", "force_skip"))
        .when(sensitive(payload), out(F.lit("escalate"), F.lit(1.0), "heuristic", ""))
        .when(h_conf >= v.DECISION_CONFIDENCE, out(h_intent, h_conf, "heuristic", ""))
        .when(bad_model, F.raise_error(F.lit("model verdict outside the taxonomy")))
        .when(m_intent.isNull() & tag.isNotNull(), out(tag, h_conf, "caller_tagged", "llm_unavailable"))
        .when(m_intent.isNull(), out(h_intent, h_conf, "heuristic", "llm_unavailable"))
        .when(overruled, out(tag, m_score, "caller_tagged", "caller_override"))
        .otherwise(out(m_intent, m_score, "llm", ""))
    )


def retention_class(intent: Column, kind: Column) -> Column:
    by_intent = F.coalesce(lookup(intent, v.RETENTION_OF_INTENT), F.lit("narrative"))
    return F.when(blank(kind), by_intent).otherwise(kind)
