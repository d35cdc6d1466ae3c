"""The registered queries of the training-data operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_counts")
def op5(spark, sf_dir):
    from memspark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op6_exact_dedup", EXACT_SQL)
def op6(spark, sf_dir):
    from memspark.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op10_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), many AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first IS NOT NULL AND first <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN many USING (k) GROUP BY doc_id
""",
)
def op10(spark, sf_dir):
    from memspark.llm.line_dedup import drop_repeated_lines

    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op1_near_dedup")
def op1(spark, sf_dir):
    from memspark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_vector_dedup")
def op9(spark, sf_dir):
    from memspark.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def toxicity_scores(docs, sf_dir):
    from memspark.llm.toxicity import learn, toxicity

    spark = docs.sparkSession
    model = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity(docs, model)


@query("op2_toxicity")
def op2(spark, sf_dir):
    from memspark.llm.toxicity import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, sf_dir).select("doc_id", fold().alias("held_out"), "score", "predicted")


@query("op8_warc")
def op8(spark, sf_dir):
    from memspark.llm.warc import archive

    found = archive(table(spark, sf_dir, "pages"))
    number = lambda c: F.col(c).cast("long").alias(c)
    return found.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    from memspark.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


@query("op7_training_order")
def op7(spark, sf_dir):
    from memspark.llm.token_shards import training_order

    read = training_order(table(spark, sf_dir, "documents").select("text"), vocabulary("byte_bpe_50k.json"))
    return read.select("slot", "sequence_id", "shard", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_pieces")
def op4(spark, sf_dir):
    from memspark.llm import pieces

    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = pieces.encode(docs, model, decoded="decoded")
    return read.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), pieces.checksum().alias("ids_crc32"), F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip")
    )


def crc_sql(value: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, which has no function for it: the polynomial, bit by bit."""
    bit = f"(ascii(substr({value}, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1"
    bits = f"list_transform(range(8 * length({value})), lambda i: CAST({bit} AS BIGINT))"
    step = "xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, b: {step}))"


def merkle_sql(levels: int = 6, group_levels: int = 4) -> str:
    """``levels`` and ``group_levels`` bound the heights: 16 ** 6 rows in a source, 16 ** 4 sources."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"

    def tree(name: str, base: str, height: int) -> str:
        run = "OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        parts = [f"{name}0 AS ({base})"]
        for k in range(height):
            parts.append(f"""{name}s{k} AS (
  SELECT g, pos, n, node, n > 1 AS open, array_to_string((list(node) {run})[1:CAST(pos % 16 AS BIGINT)], '') AS l, array_to_string((list(node) {run})[CAST(pos % 16 + 2 AS BIGINT):], '') AS r FROM {name}{k})""")
            parts.append(f"""{name}{k + 1} AS (
  SELECT g, pos // 16 AS pos, CAST(ceil(max(n) / 16.0) AS BIGINT) AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node FROM {name}{k} GROUP BY g, pos // 16)""")
        return ",\n".join(parts)

    joins, proof = "", []
    for name, height, pos in (("t", levels, "d.pos"), ("u", group_levels, "x.pos")):
        if name == "u":
            joins += "\n  JOIN (SELECT row_number() OVER (ORDER BY g) - 1 AS pos, g AS name FROM subs) x ON x.name = d.g"
        for k in range(height):
            a = f"{name}s{k}"
            joins += f"\n  JOIN {a} ON {a}.g = {'d.g' if name == 't' else repr('')} AND {a}.pos = {pos} // {16**k}"
            proof.append(f"CASE WHEN {a}.open THEN {a}.l || {a}.r ELSE '' END")
    # Folding nests once per level; written as a chain of subqueries it stays linear in the height.
    steps = [f"{n}s{k}" for n, h in (("t", levels), ("u", group_levels)) for k in range(h)]
    sides = ", ".join(f"{a}.open AS o_{a}, {a}.l AS l_{a}, {a}.r AS r_{a}" for a in steps)
    chain = "SELECT *, coalesce(altered, leaf) AS node FROM met"
    for a in steps:
        chain = f"SELECT * REPLACE (CASE WHEN o_{a} THEN sha256(l_{a} || node || r_{a}) ELSE node END AS node) FROM ({chain})"
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf,
    CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered
  FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM docs),
{tree('t', "SELECT g, pos, n, leaf AS node FROM d", levels)},
subs AS (SELECT g, node FROM t{levels}),
{tree('u', "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, node FROM subs", group_levels)},
met AS (
  SELECT d.doc_id, d.leaf, d.altered, subs.node AS subroot, u{group_levels}.node AS root, sha256({' || '.join(proof)}) AS proof_sha256, {sides}
  FROM d JOIN subs ON subs.g = d.g CROSS JOIN u{group_levels}{joins})
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM ({chain})
"""


@query("op13_merkle_manifest", merkle_sql())
def op13(spark, sf_dir):
    """Every fifth document (by CRC) is proved with its ASCII letters in lower case, which must fail unless nothing changed."""
    from memspark.llm import merkle
    from memspark.llm.line_dedup import _LOWER, _UPPER

    columns = ("doc_id", "source", "lang", "n_chars")
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*columns, F.translate("text", _UPPER, _LOWER)))
    found = merkle.manifest(docs.withColumn("tampered", tampered), columns=(*columns, "text"), carry=("tampered",))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '<turn ', '\lturn '), '</turn>', '\l/turn>'), '<part ', '\lpart ')"


@query(
    "op12_chat_format",
    rf"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
    sum(length({_ESCAPED.format("text")}) + length(replace({_ESCAPED.format("role")}, '>', '\g')) + 16) AS chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM said
""",
)
def op12(spark, sf_dir):
    from memspark.llm import chat_format as chat

    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = chat.format_chat(rows.withColumn("parts", chat.text_part(F.col("text"))))
    turns = F.transform(chat.turn_texts(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = chat.loss_text(F.col("formatted"), F.col("loss"))
    read = done.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


_TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations),
c AS (SELECT DISTINCT conv_id, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM conversations),
rebuilt AS (
  SELECT c.conv_id, pos, id, strlen(text) AS b FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE pos <= h
  UNION ALL SELECT c.conv_id, pos, id, strlen(text) FROM c JOIN t USING (conv_id) WHERE pos > h),
s AS (SELECT conv_id, id, b, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM rebuilt),
p AS (
  SELECT conv_id, d, b, sha256(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p),
node AS (
  SELECT k, d, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM q GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
above AS (SELECT DISTINCT q.k, a.k AS top FROM q JOIN p a ON a.conv_id = q.conv_id AND a.d <= q.d),
sums AS (
  SELECT above.top AS k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((node.n - 1) * node.b) AS saved
  FROM above JOIN node ON node.k = above.k LEFT JOIN kids ON kids.k = node.k GROUP BY above.top)
SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN node parent ON parent.k = node.up
"""


def branched(found):
    """Every conversation begins with the first turns of the one at the head of its five, as many as its CRC says."""
    from memspark.llm.prefix_trie import _ID

    h = F.coalesce((F.crc32(F.col("conv").cast("string")) % 9).cast("int"), F.lit(0))
    own = found.withColumn("from", F.col("conv") - F.col("conv") % 5).withColumn("h", h)
    heads = found.select(F.col("conv").alias("from"), F.substring("ids", 1, 8 * _ID).alias("first_ids"), F.slice("sizes", 1, 8).alias("first_sizes"))
    met = own.join(heads, "from", "left")
    return met.select(
        "conv",
        F.concat(F.substring(F.coalesce("first_ids", F.lit(b"")), F.lit(1), F.col("h") * _ID), F.substring("ids", F.col("h") * _ID + 1, F.length("ids"))).alias("ids"),
        F.concat(F.slice(F.coalesce("first_sizes", F.array().cast("array<bigint>")), F.lit(1), F.col("h")), F.slice("sizes", F.col("h") + 1, F.size("sizes"))).alias("sizes"),
    )


@query("op11_prefix_trie", _TRIE_SQL)
def op11(spark, sf_dir):
    from memspark.llm.prefix_trie import sequences, trie

    return trie(branched(sequences(table(spark, sf_dir, "conversations"))))
