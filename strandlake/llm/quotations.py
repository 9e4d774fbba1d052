"""Chat formatting by quotation linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut_lineage

#: Quote marks at a line's start: each > is a level, blanks between them don't count.
MARKS = r"^((?:[ \t]*>)*)"

#: Whether a text has a quoted line at all.
QUOTED = r"(?m)^[ \t]*>"

#: A line that announces a quotation, and goes with it.
ANNOUNCES = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


#: What parts paragraphs, and what parts sentences.
BLANK_LINE = r"\n[ \t]*\n"
SENTENCE_END = r"[.!?]+[ \t\n]+|\n[ \t]*\n"


def normal(text: Column) -> Column:
    """Lower-cased letters and digits with one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parts_of(text: Column) -> Column:
    """The distinct normalised texts of a passage: the whole, its lines, its paragraphs and its sentences, none of them empty."""
    pieces = F.concat(F.array(text), F.split(text, "\n", -1), F.split(text, BLANK_LINE, -1), F.split(text, SENTENCE_END, -1))
    return F.array_distinct(F.filter(F.transform(pieces, normal), lambda x: x != ""))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with lines (level, content), passages (level, parts) and body, the text without quotes.

    A passage is a run of lines of one level: its normalised text as a whole, by lines, by paragraphs (runs of lines without a
    blank one, however wrapped) and by sentences. A line that announces a quotation and the quoted lines leave the body.
    """
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))
    content = lambda line: F.when(level(line) > 0, F.ltrim(F.regexp_replace(line, MARKS, ""))).otherwise(line)
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n", -1), lambda line: F.struct(level(line).alias("level"), content(line).alias("content")))
    with_lines = messages.withColumn("lines", lines).withColumn("size_", F.size("lines"))
    bounds = F.filter(F.sequence(F.lit(0), F.col("size_") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    with_bounds = with_lines.withColumn("bounds_", bounds)

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("bounds_", k + 1), F.col("size_"))
        part = F.transform(F.slice("lines", start + 1, end - start), lambda x: x["content"])
        return F.struct(F.get("lines", start)["level"].alias("level"), parts_of(F.array_join(part, "\n")).alias("parts"))

    runs = F.filter(F.transform("bounds_", run), lambda p: F.size(p["parts"]) > 0)
    announces = lambda x, i: x["content"].rlike(ANNOUNCES) & F.coalesce(F.get("lines", i + 1)["level"] > 0, F.lit(False))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~announces(x, i))
    body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    whole = F.when(quoted, body).otherwise(F.coalesce(F.col(text_col), F.lit("")))
    return with_bounds.withColumn("runs_", runs).withColumn("body", whole).withColumn("passages", F.filter("runs_", lambda p: p["level"] > 0)).withColumn("own_runs", F.filter("runs_", lambda p: p["level"] == 0)).drop("bounds_", "size_", "runs_")


def keys_of(run: Column) -> Column:
    """(hash, weight) of the parts of a passage; the weight is the length of what was hashed. Parts are distinct texts."""
    return F.transform(run["parts"], lambda text: F.struct(F.xxhash64(text).alias("key"), F.length(text).alias("weight")))


def link_quotes(quoting: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of the quoting messages (parsed) with a passage that an earlier one of the
    conversation wrote. Of messages, only those in conversations with quotes are parsed and hashed.

    A key's original is the first turn that wrote it in its own words, found by one minimum for each key, so a passage
    that a third of all messages share is one row on that side. A passage links to the original that covers most of it;
    a message replies to the original of its shallowest linked passage, the latest one of several.
    """
    body = F.struct(F.lit(0).alias("level"), F.array(normal(F.col("body"))).alias("parts"))
    conversations = quoting.select(F.col("conv_id").alias("quoted_in")).distinct()
    parsed = parse_quotes(messages.join(conversations, F.col("conv_id").eqNullSafe(F.col("quoted_in")), "left_semi"))
    # Outer explodes: an inner one puts a filter on the arrays below the projections that make them, where the whole text
    # would be split again for every line.
    runs = parsed.select("conv_id", "turn", F.explode_outer(F.array_append("own_runs", body)).alias("run"))
    written = runs.select("conv_id", "turn", keys_of(F.col("run"))["key"].alias("keys")).select("conv_id", "turn", F.explode_outer("keys").alias("key"))
    first = written.where(F.col("turn").isNotNull() & F.col("key").isNotNull()).groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    first = first.select(F.col("conv_id").alias("in_conv"), F.col("key").alias("in_key"), "origin")
    cited = quoting.select("conv_id", "turn", F.posexplode_outer("passages").alias("passage", "run"))
    keyed = cited.select("conv_id", "turn", "passage", F.col("run.level").alias("level"), keys_of(F.col("run")).alias("ks"))  # so that no row below has the passage
    cited = keyed.select("conv_id", "turn", "passage", "level", F.explode_outer("ks").alias("k")).where(F.col("k").isNotNull())
    met = cited.join(first, cited["conv_id"].eqNullSafe(first["in_conv"]) & (cited["k.key"] == first["in_key"])).where(F.col("origin") < F.col("turn"))
    weighed = met.groupBy("conv_id", "turn", "passage", "level", "origin").agg(F.sum("k.weight").alias("weight"))
    chosen = weighed.groupBy("conv_id", "turn", "passage", "level").agg(F.max_by("origin", F.struct("weight", "origin")).alias("origin"))
    return chosen.groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct("level", -F.col("origin"))).alias("reply_to"), F.count("*").alias("n_linked"))


def thread_roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """links with root_turn and depth: the message that a chain of replies begins with, and the chain's length.

    Each round joins every chain to the one that begins at its end, so rounds grow with the logarithm of the depth.
    """
    chains = cut_lineage(links.select("conv_id", "turn", "reply_to", "n_linked", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    for _ in range(most_rounds):
        onward = chains.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("further"), F.col("depth").alias("more"))
        joined = chains.join(onward, chains["conv_id"].eqNullSafe(onward["c"]) & (chains["root_turn"] == onward["t"]), "left")
        if joined.where(F.col("further").isNotNull()).isEmpty():
            return chains
        chains = cut_lineage(joined.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("further", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    raise RuntimeError(f"reply chains haven't ended in {most_rounds} rounds")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with position, 0, 1, ... in each group by order, without bringing a group together.

    Rows are range-partitioned by (group, order); each partition numbers its part of a group, and the parts before it
    are added from counts for each group and partition.
    """
    placed = rows.withColumn("tie_", F.monotonically_increasing_id())
    placed = cut_lineage(placed.repartitionByRange(group, *order, "tie_").withColumn("part_", F.spark_partition_id()))
    counts = placed.groupBy(group, "part_").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cut_lineage(counts.select(F.col(group).alias("group_"), F.col("part_").alias("of_part_"), before.alias("before_")))
    local = F.row_number().over(Window.partitionBy(group, "part_").orderBy(*order, "tie_"))
    both = placed.withColumn("local_", local).join(base, placed[group].eqNullSafe(base["group_"]) & (placed["part_"] == base["of_part_"]))
    return both.withColumn("position", (F.col("local_") + F.col("before_") - 1).cast("long")).drop("tie_", "part_", "group_", "of_part_", "before_", "local_")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Every message (conv_id, turn, role, text) without its quotes, in reply order.

    Columns: conv_id, turn, role, text (without quotes), n_quotes (passages), quote_depth (deepest level), n_linked
    (passages whose original was found), reply_to (turn of the message that it answers, or null), root_turn (where its
    chain of replies begins), depth (replies since then), position (0, 1, ... in the conversation: threads by root_turn,
    in each by turn, so an answer never stands before what it answers).

    Links stay within a conversation and go to earlier turns. A null text counts as empty; rows with a null turn link to
    nothing and stand first; null conv_ids are a conversation; repeated rows stay, next to each other, with the same
    links; an empty table gives no rows; other columns of messages are ignored.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    has_quotes = F.coalesce(F.col("text").rlike(QUOTED), F.lit(False))
    quoting, plain = parse_quotes(rows.where(has_quotes)), rows.where(~has_quotes)
    chains = thread_roots(link_quotes(quoting, rows))
    linked = chains.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", "n_linked", "root_turn", "depth")
    depth = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0))
    slim = quoting.select("conv_id", "turn", "role", F.col("body").alias("text"), F.size("passages").alias("n_quotes"), depth.alias("quote_depth"))
    slim = slim.unionByName(plain.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("n_quotes"), F.lit(0).alias("quote_depth")))
    out = slim.join(linked, slim["conv_id"].eqNullSafe(linked["c"]) & (slim["turn"] == linked["t"]), "left").drop("c", "t")
    out = out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    columns = ["conv_id", "turn", "role", "text", "n_quotes", "quote_depth", "n_linked", "reply_to", "root_turn", "depth", "position"]
    return numbered(out, "conv_id", ["root_turn", "turn", "role", "text"]).select(columns)


def pack_conversations(linked: DataFrame, turns: int = 64) -> DataFrame:
    """conv_id, part and messages (position, role, text): conversations in reply order, `turns` messages to a row."""
    part = F.floor(F.col("position") / turns).cast("long")
    return linked.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("messages"))
