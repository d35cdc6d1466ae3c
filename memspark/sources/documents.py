"""Text sources: JSON lines, JSON documents, markdown with front matter; log rows."""

from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions.common import fail_when
from memspark.session import checkpointed

try:  # general YAML needs the package; flat mappings do not
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

CORPUS_SCHEMA = "fact_id string, kind string, content string, valid_from timestamp, valid_to timestamp, episode_id string"
CASE_SCHEMA = "case_id string, version int, source string, intent_class string, contamination_protected boolean, tags array<string>, payload string"
_ENVELOPE = r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*\r?\n(.*)\z"
_PLAIN = r"^([\p{L}_]([\p{L}\p{N}_./ -]*[\p{L}\p{N}_./-])?|0|[1-9]\d*)$"  # text YAML reads back unchanged
_RESERVED = r"(?i)^(true|false|yes|no|on|off|null|y|n)$"
_LINE = r"^([^\s:#][^:]*):[ \t]*(.*?)[ \t]*$"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Facts from JSON lines; blank lines are skipped, a broken line or one without ``fact_id`` fails the job."""
    rows = spark.read.schema(CORPUS_SCHEMA).option("mode", "FAILFAST").json(path)
    named = fail_when(F.col("fact_id").isNull(), "corpus row without fact_id", F.col("fact_id"))
    return rows.withColumn("fact_id", named).select(
        "*", F.col("valid_from").alias("recorded_at"), F.lit(1).cast("bigint").alias("version"),
        F.concat(F.lit("corpus://"), "fact_id").alias("source_uri"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).json(path)


def read_vector_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, queries) of a JSON document with ``dim``, ``facts`` and ``queries``.

    A vector of another length than ``dim``, of a fact or of a query, fails the job.
    """
    schema = (
        "dim int, facts map<string, array<double>>, "
        "queries array<struct<query_id: string, query: string, relevant_fact_ids: array<string>, vector: array<double>>>"
    )
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    checked = doc.withColumn("dim", F.when(F.col("dim").isNull(), F.raise_error(F.lit("document without dim"))).otherwise(F.col("dim")))

    def fitting(vec: Column) -> Column:
        return fail_when(F.size(vec) != F.col("dim"), F.concat(F.lit("vector dimension "), F.size(vec).cast("string"), F.lit(" is not "), F.col("dim").cast("string")), vec)

    vectors = checked.select("dim", F.explode("facts").alias("fact_id", "vec")).withColumn("vec", fitting(F.col("vec")))
    queries = checked.select("dim", F.explode("queries").alias("q")).select(
        "q.query_id", F.col("q.query").alias("text"), "q.relevant_fact_ids", fitting(F.col("q.vector")).alias("vec")
    )
    return vectors.select("fact_id", "vec"), queries


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def has_front_matter(text: Column) -> Column:
    return text.rlike(_ENVELOPE)


def front_matter_block(text: Column) -> Column:
    return F.when(has_front_matter(text), F.regexp_extract(text, _ENVELOPE, 1))


def body(text: Column) -> Column:
    """Text behind the front matter; the whole text when there is none."""
    return F.when(has_front_matter(text), F.regexp_extract(text, _ENVELOPE, 2)).otherwise(text)


def flat_front_matter(text: Column) -> Column:
    """``map<string,string>`` of a flat mapping, one ``key: value`` per line; quotes are removed."""
    lines = F.split(F.coalesce(front_matter_block(text), F.lit("")), r"\r?\n")
    pairs = F.filter(lines, lambda s: s.rlike(_LINE))

    def value(s: Column) -> Column:
        raw = F.regexp_extract(s, _LINE, 2)
        inside = F.regexp_replace(raw, r"^(['\"])(.*)\1$", "$2")
        return F.when(raw.rlike("^'.*'$"), F.replace(inside, F.lit("''"), F.lit("'"))).otherwise(inside)

    return F.map_from_entries(F.transform(pairs, lambda s: F.struct(F.regexp_extract(s, _LINE, 1), value(s))))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _yaml_map(blocks: pd.Series) -> pd.Series:
    def one(block):
        if block is None or not block.strip():
            return {}
        got = yaml.safe_load(block)
        if got is None:
            return {}
        if not isinstance(got, dict):
            raise ValueError(f"front matter must be a mapping, not {type(got).__name__}")
        return {str(k): str(x) for k, x in got.items()}

    return blocks.map(one)


def front_matter(text: Column) -> Column:
    """``map<string,string>`` of any YAML mapping; nested values become their text."""
    return flat_front_matter(text) if yaml is None else _yaml_map(front_matter_block(text))


def _scalar(value: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    checked = fail_when(value.rlike("[\\r\\n]"), "front matter value with a line break", value)
    return F.when(value.rlike(_PLAIN) & ~value.rlike(_RESERVED), checked).otherwise(fail_when(value.rlike("[\\r\\n]"), "front matter value with a line break", quoted))


def render(metadata: Column, body_: Column) -> Column:
    """Markdown text with sorted front matter; no envelope for an empty map.

    Values that YAML would read as something else than their text are put in single quotes; one with a line break fails.
    """
    entries = F.array_sort(F.map_entries(metadata))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), _scalar(e["value"]))), "\n")
    return F.when(F.size(metadata) > 0, F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), body_)).otherwise(body_)


def write_markdown(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages(page, text)``, each as the file ``<page>.md`` below ``path``, and return (page, file, bytes).

    Characters of a page name that cannot stand in a file name are percent-encoded.  The file holds the text and nothing
    else; a repeated task writes the same files again.
    """
    folder = path if "://" in path else f"file://{path}"

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for page, text in zip(batch.column("page").to_pylist(), batch.column("text").to_pylist()):
                name, data = f"{quote(page, safe=' ')}.md", (text or "").encode()
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(data)
                out.append((page, name, len(data)))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["page", "file", "bytes"])

    return checkpointed(pages.select(F.col("page").cast("string").alias("page"), "text").mapInArrow(write, "page string, file string, bytes long"))


def log_rows(entries: DataFrame, columns: tuple[str, ...], kind: str, at: Column) -> DataFrame:
    """Log rows whose payload is a JSON object with sorted keys, nulls written out."""
    payload = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return entries.select(F.lit(kind).alias("kind"), payload.alias("payload_json"), at.alias("appended_at"))


def replay(log: DataFrame, payload_schema: str) -> DataFrame:
    """Log rows in sequence order with the payload parsed."""
    return log.withColumn("payload", F.from_json("payload_json", payload_schema)).orderBy("seq")
