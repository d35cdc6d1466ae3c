"""Chat formatting with typed content parts.

A message has a role and an ordered list of parts: text, image, audio or document.  A visitor turns every
part into a piece of the formatted conversation.  Text goes in with its control strings escaped; any other
part leaves a numbered placeholder, its reference and the number of tokens it stands for are recorded.
Built-in functions only.

A conversation is a sequence of turns ``<turn ROLE>\\nTEXT</turn>\\n``; a placeholder is ``<part KIND NUMBER/>``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, PART = "<turn ", "</turn>\n", "<part "
#: Strings that mark something in the formatted text; their ``<`` is written as ``\l`` inside texts.
CONTROL = (OPEN, "</turn>", PART)
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit("\\l" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: every pair of backslashes is one, what lies between holds ``\\l`` only for ``<``."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def _role(role: Column) -> Column:
    """A role is one word of the header; the character that ends the header is written as ``\\g``."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _role_back(role: Column) -> Column:
    plain = lambda p: F.replace(F.replace(p, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), plain), "\\")


def text_part(text: Column) -> Column:
    """The parts of a message that is only text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast("array<struct<type:string,text:string>>")


def _visit(p: Column, number: Column, patch: int, audio_rate: float, page_tokens: int) -> tuple[Column, Column]:
    """(piece of the conversation, tokens it stands for) of one part; tokens are null for text."""
    cells = F.ceil(F.coalesce(p["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(p["height"], F.lit(0)) / patch)
    heard = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate)
    shown = F.coalesce(p["pages"], F.lit(0)) * page_tokens
    kind = p["type"]
    tokens = F.when(kind == "text", F.lit(None)).when(kind == "image", cells).when(kind == "audio", heard).when(kind == "document", shown)
    placeholder = F.concat(F.lit(PART), kind, F.lit(" "), number.cast("string"), F.lit("/>"))
    return F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder), tokens.cast("long")


def format_chat(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",),
    patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024,
) -> DataFrame:
    """One row per conversation: ``conversation, n_turns, formatted, loss, attachments, expanded_tokens``.

    ``parts`` is an array of structs of the fields of ``PARTS`` (those after ``type`` and ``text`` may lack); its types are text, image, audio and
    document, anything else fails the job.  ``loss`` lists the texts to learn from, those of the roles ``learn``, in
    order: (turn, at, start, length) with ``at`` counted in code points from the beginning of the turn and
    ``start`` from that of the conversation.  ``attachments`` lists (number, turn, kind, ref, tokens); an image counts its
    patches, a sound its seconds, a document its pages.  ``expanded_tokens`` is their sum.

    Messages are ordered by turn (null first), then role, text and other parts; messages that repeat are all kept.  Null roles,
    texts and part lists count as empty, a message without parts is a turn with an empty text.  Rows with a null
    conversation form one conversation.  An empty table gives no row.  Other columns are not read.

    Everything is worked out per part before the parts of a conversation meet; a conversation becomes one
    string, so its length is bounded by that of a string (2 GB), and a group is never larger than this result.
    """
    given = {f.name for f in messages.schema[parts].dataType.elementType.fields}
    kinds = {"type": "string", "text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    full = F.transform(F.coalesce(F.col(parts), F.array()), lambda p: F.struct(*((p[f] if f in given else F.lit(None)).cast(t).alias(f) for f, t in kinds.items())))
    rows = messages.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), full.alias("parts"))
    words = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    order = [F.asc_nulls_first("t"), F.col("role"), words, F.to_json("parts")]  # values behind the role are compared for ties only
    by_turn = Window.partitionBy("c").orderBy(*order)
    rows = rows.withColumn("turn", F.row_number().over(by_turn) - 1)
    rows = rows.select("c", "turn", "role", F.posexplode_outer("parts").alias("pos", "p"))
    attached = F.col("p.type") != "text"
    in_order = Window.partitionBy("c").orderBy("turn", "pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("number", F.count(F.when(attached, 1)).over(so_far))
    piece, tokens = _visit(F.col("p"), F.col("number"), patch, audio_rate, page_tokens)
    unknown = F.col("p").isNotNull() & ~F.coalesce(F.col("p.type").isin("text", "image", "audio", "document"), F.lit(False))
    piece = F.when(unknown, F.raise_error(F.concat(F.lit("unknown part type "), F.coalesce("p.type", F.lit("null"))))).otherwise(F.coalesce(piece, F.lit("")))
    first, last = F.coalesce("pos", F.lit(0)) == 0, F.coalesce(F.lead("turn").over(in_order) != F.col("turn"), F.lit(True))
    head = F.when(first, F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(">\n"))).otherwise(F.lit(""))
    rows = rows.select("c", "turn", "pos", "role", "p", "number", tokens.alias("tokens"), head.alias("head"), piece.alias("piece"), F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"))
    size = (F.length("head") + F.length("piece") + F.length("tail")).cast("long")
    before = F.coalesce(F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    in_turn = Window.partitionBy("c", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(in_turn), F.lit(0)) + F.length("head")
    rows = rows.select("*", before.alias("start"), at.alias("at"))
    learnt = F.col("role").isin(*learn) & (F.col("p").isNull() | ~attached)
    loss = F.struct("turn", F.coalesce("pos", F.lit(0)).alias("pos"), "at", "start", F.length("piece").cast("long").alias("length"))
    shown = F.struct("number", "turn", F.col("p.type").alias("kind"), F.col("p.ref").alias("ref"), "tokens")
    out = rows.groupBy("c").agg(
        (F.max("turn") + 1).cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("turn", "pos", F.concat("head", "piece", "tail").alias("piece")))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(learnt, loss))).alias("loss"), F.sort_array(F.collect_list(F.when(attached, shown))).alias("attachments"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("expanded_tokens"),
    )
    return out.select(
        F.col("c").alias(conversation), "n_turns", F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.transform("loss", lambda s: s.dropFields("pos")).alias("loss"), "attachments", "expanded_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, parts), a part is (type, text, number).

    Neighbouring texts come back as one, empty texts beside placeholders do not."""
    blocks = F.split(formatted, r"</turn>\n", -1)
    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), _turn)


def _turn(block: Column) -> Column:
    end = F.locate(">\n", block)
    body = F.split(F.substring(block, end + 2, F.length(block)), r"(?=<part )|(?<=/>)(?<=<part [a-z]{1,9} [0-9]{1,19}/>)", -1)
    # Beside a placeholder there need not be text.
    body = F.when(F.size(body) > 1, F.filter(body, lambda p: p != "")).otherwise(body)
    return F.struct(_role_back(F.substring(block, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)).alias("role"), F.transform(body, _part).alias("parts"))


def _part(piece: Column) -> Column:
    words = F.split(piece, "[ /]")
    held = F.startswith(piece, F.lit(PART))
    return F.struct(
        F.when(held, words[1]).otherwise(F.lit("text")).alias("type"), F.when(~held, unescape(piece)).alias("text"),
        F.when(held, F.get(words, F.lit(2)).cast("long")).alias("number"),
    )


def turn_texts(formatted: Column) -> Column:
    """The turns of a formatted conversation as array of (role, text), placeholders left out."""
    only = lambda parts: F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return F.transform(read_turns(formatted), lambda t: F.struct(t["role"].alias("role"), only(t["parts"]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped; each span is cut from its own turn, so long conversations cost no more per turn."""
    blocks = F.split(formatted, r"</turn>\n", -1)
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(F.get(blocks, s["turn"]), (s["at"] + 1).cast("int"), s["length"].cast("int")))), "")
