"""Chat formatting over typed content parts, and reading the formatted string back.

A turn's content is an array of parts ``struct<kind, text, ref, width, height, seconds, pages>``. The visitor flattens them in
order: a text part is its escaped text, any other part a placeholder ``<|image|>``, ``<|audio|>`` or ``<|document|>``; its reference
is recorded with the turn, the part's place and the number of tokens that the placeholder stands for. A formatted turn is
``<|im_start|>ROLE<|im_sep|>BODY<|im_end|>`` and a newline. Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``;
a bar that begins a further part becomes ``\\|``, as the part before it may end in ``<``. So neither a text nor neighbouring parts
together can contain a control string, and dropping the first of each pair of backslash and character restores what was said.

Defined results: null texts, roles and parts are empty; an unknown kind of part is treated as a document; turns are ordered by turn
(null first), then role, then body, so that ties and repeated rows have one order; a null conversation id is a conversation; a text
or conversation is formatted as a whole however long it is; an empty table gives an empty result; only the four named columns are
read, so further ones, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def part_tokens(part: Column, tile: int = 28, audio_per_second: int = 25, per_page: int = 1024) -> Column:
    """Tokens a placeholder expands to: an image's tiles, an audio's frames, a document's pages; at least one."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / tile) * F.ceil(F.coalesce(part["height"], F.lit(0)) / tile)
    n = F.when(part["kind"] == "image", tiles).when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_per_second)).otherwise(F.coalesce(part["pages"], F.lit(1)) * per_page)
    return F.greatest(n.cast("long"), F.lit(1).cast("long"))


def _kind(part: Column) -> Column:
    return F.when(F.coalesce(part["kind"], F.lit("document")).isin("text", "image", "audio"), part["kind"]).otherwise("document")


def body(parts: Column) -> Column:
    """The visitor's text: escaped texts and placeholders in the parts' order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    bar = lambda p, i: F.when((i > 0) & F.startswith(F.coalesce(p["text"], F.lit("")), F.lit("|")), "\\").otherwise("")
    visit = lambda p, i: F.when(_kind(p) == "text", F.concat(bar(p, i), escape(p["text"]))).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))
    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """The visitor's record: (part, kind, ref, tokens) of every part that is no text, in order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    seen = F.transform(parts, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return F.filter(seen, lambda s: s["kind"] != "text")


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, mask, attachments) from rows (conv_id, turn, role, parts).

    ``mask`` has for each loss turn (no, start, begin, end): its number, and the code-point offsets of the turn and of its body.
    Offsets are running sums over a conversation's rows, whose exchange by conv_id the grouping reuses: one shuffle. A conversation
    is one string by definition, so its rows meet in one task; that task holds one conversation, not one key's share of the corpus.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("files"))
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumns({"no": F.row_number().over(order) - 1, "start": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    packed = F.sort_array(F.collect_list(F.struct("no", "start", "role", "head", "body", "files")))
    chats = rows.groupBy("conv_id").agg(packed.alias("t"))
    written = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    spans = F.transform(
        F.filter("t", lambda t: t["role"].isin(*loss_roles)),
        lambda t: F.struct(t["no"].alias("no"), t["start"].alias("start"), (t["start"] + F.length(t["head"])).alias("begin"), (t["start"] + F.length(t["head"]) + F.length(t["body"])).alias("end")),
    )
    files = F.flatten(F.transform("t", lambda t: F.transform(t["files"], lambda f: F.struct(t["no"].alias("no"), f["part"].alias("part"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return chats.select("conv_id", written.alias("formatted"), spans.alias("mask"), files.alias("attachments"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted, attachments): roles and texts parsed from the formatted string, and the unescaped text under the mask.

    The string is split at turn marks once; a masked span is then cut out of its own turn, so long conversations take linear time.
    """
    cut = F.split(F.col("formatted"), r"<\|im_start\|>").alias("c")
    parsed = chats.select("conv_id", "formatted", "mask", "attachments", F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))).alias("segments"))

    def turn(s: Column) -> Column:
        parts = F.split(F.substring(s, F.lit(1), F.length(s) - F.lit(len(END))), r"<\|im_sep\|>", 2)
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text"))

    under = F.transform("mask", lambda m: unescape(F.substring(F.get(F.col("segments"), m["no"]), (m["begin"] - m["start"] - len(START) + 1).cast("int"), (m["end"] - m["begin"]).cast("int"))))
    return parsed.select("conv_id", "formatted", F.transform("segments", turn).alias("turns"), F.array_join(under, "").alias("loss"), "attachments")
