"""Quotations in conversations: linked to the messages they come from, and cut out; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.llm.common import materialize

#: The marks that open a quoted line, and the mark alone.
QUOTED = "^[ \\t]*((?:>[ \\t]?)+)"
SPACES = "[\\s]+"
#: Characters of a normalised passage from which it is looked for in other conversations; shorter ones are said everywhere.
LEAST_ELSEWHERE = 16
#: Messages of a block of an assembled conversation.
BLOCK = 1000


def _level(line: Column) -> Column:
    """Quote level of a line: its opening marks, which may have spaces between."""
    marks = F.regexp_extract(line, QUOTED, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def _plain(text: Column) -> Column:
    """Lower-cased text with single spaces, for comparing passages."""
    return F.lower(F.trim(F.regexp_replace(text, SPACES, " ")))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda variable is not copied into each place that uses it."""
    return F.transform(F.array(value), use)[0]


def _parts(text: Column) -> Column:
    """The runs of lines of one level of a text, (level, text without marks), blank runs left out; null text: none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, QUOTED, "").alias("text")))

    def runs(lines: Column) -> Column:
        # a run starts where the level changes; it ends where the next one starts
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i - 1)["level"] != F.get(lines, i)["level"]))

        def run(starts: Column, start: Column, at: Column) -> Column:
            part = F.slice(lines, start + 1, F.coalesce(F.get(starts, at + 1), F.size(lines)) - start)
            return F.struct(F.get(lines, start)["level"].alias("level"), F.array_join(F.transform(part, lambda x: x["text"]), "\n").alias("text"))

        return _let(starts, lambda found: F.transform(found, lambda start, at: run(found, start, at)))

    return F.filter(_let(lines, runs), lambda p: F.trim(F.regexp_replace(p["text"], SPACES, " ")) != "")


def parse(messages: DataFrame) -> DataFrame:
    """Adds parts: the runs of lines of one level, (level, text without marks), blank runs left out; null text: none.

    A message of any length is parsed by itself, so there is no shuffle.
    """
    return messages.withColumn("parts", _parts(F.col("text")))


def _units(rows: DataFrame) -> DataFrame:
    """rows (.., level, text) of parts -> the part itself and, if it has several lines, each of them: level, whole, hash, size."""
    unit = lambda whole, text: F.struct(F.lit(whole).alias("whole"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    several = _let(lines, lambda found: F.when(F.size(found) > 1, F.transform(found, lambda x: unit(False, _plain(x)))).otherwise(F.array().cast("array<struct<whole:boolean,text:string>>")))
    units = F.concat(F.array(unit(True, _plain(F.col("text")))), several)
    out = rows.withColumn("_unit", F.explode(units)).drop("text")
    return out.select("*", F.col("_unit.whole").alias("whole"), F.xxhash64("_unit.text").alias("h1"), F.hash("_unit.text").alias("h2"), F.length("_unit.text").alias("size")).drop("_unit").where("size > 0")


def link(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, text) -> (conv_id, turn, level, from_conv, from_turn, chars): quoted passages found.

    A passage comes from the first message that has it as its own words: in the same conversation before the
    turn, else, from LEAST_ELSEWHERE characters, the first of all other conversations. First uses are one row a passage and conversation, made by
    aggregation, so a passage that a third of all messages repeat still joins to one row. A passage that has
    no match as a whole is matched line by line. Passages quoted from nowhere give no row.
    """
    parts = parse(messages.select("conv_id", "turn", "text")).select("conv_id", "turn", F.explode("parts").alias("p")).select("conv_id", "turn", F.col("p.level").alias("level"), F.col("p.text").alias("text"))
    quotes = materialize(_units(parts.where("level > 0")).groupBy("conv_id", "turn", "level", "whole", "h1", "h2").agg(F.max("size").alias("size")), "quotes")
    # only passages that someone quotes are looked for
    wanted = quotes.select("h1", "h2").distinct()
    own = _units(parts.where("level = 0")).join(wanted, ["h1", "h2"], "left_semi")
    here = materialize(own.groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("first")), "uses")
    # the first two conversations that have a passage: one of them is not the quoting one
    there = here.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "first")).alias("o"))
    others = here.join(there, ["h1", "h2"]).where(F.col("conv_id") != F.col("o.conv_id")).groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "first")).alias("o2"))
    met = quotes.join(here, ["conv_id", "h1", "h2"], "left").join(there, ["h1", "h2"], "left").join(others, ["h1", "h2"], "left")
    inside = F.col("first") < F.col("turn")
    elsewhere = F.when(F.col("size") >= LEAST_ELSEWHERE, F.when(F.col("o.conv_id") != F.col("conv_id"), F.col("o")).otherwise(F.col("o2")))
    met = met.withColumn("o", F.when(inside, F.struct("conv_id", "first")).otherwise(elsewhere)).where("o IS NOT NULL")
    found = met.groupBy("conv_id", "turn", "level", F.col("o.conv_id").alias("from_conv"), F.col("o.first").alias("from_turn")).agg(F.max("whole").alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("size"))).alias("by_line"), F.max(F.when(F.col("whole"), F.col("size")).otherwise(0)).alias("at_once"))
    return found.select("conv_id", "turn", "level", "from_conv", "from_turn", F.greatest("by_line", "at_once").cast("long").alias("chars"))


def threads(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> the messages without their quotations, and where each belongs.

    Adds own_text, quote_level (deepest), n_quoted (passages), parent_conv and parent_turn (the message that its
    level-1 quotations take most from; ties: the one in its own conversation, then the latest turn), thread (the
    turn that its chain of parents within the conversation starts from), depth, and position, the place from 0 in
    the order by thread, depth, turn, which puts each message after the one it answers; without quotations this
    is the turn order. Rows with one conv_id and turn are ordered by role and text.
    Empty and null texts have an empty own_text and no parent; repeated rows get the same result each;
    rows with a null conv_id or turn keep their text and get no parent, without a conv_id no position. Other columns are ignored.
    """
    own = lambda parts: F.array_join(F.transform(F.filter(parts, lambda p: p["level"] == 0), lambda p: F.trim(F.regexp_replace(p["text"], "^\\n+|\\n+$", ""))), "\n\n")
    levels = lambda parts: F.filter(F.transform(parts, lambda p: p["level"]), lambda x: x > 0)
    said = _let(_parts(F.col("text")), lambda parts: F.struct(own(parts).alias("own_text"), levels(parts).alias("levels")))
    base = messages.select("conv_id", "turn", "role", said.alias("_said"))
    base = base.select("conv_id", "turn", "role", "_said.own_text", F.coalesce(F.array_max("_said.levels"), F.lit(0)).alias("quote_level"), F.size("_said.levels").alias("n_quoted"))
    best = F.max(F.struct("chars", (F.col("from_conv") == F.col("conv_id")).alias("same"), "from_turn", (-F.col("from_conv")).alias("order"), "from_conv")).alias("b")
    parents = link(messages).where("level = 1").groupBy("conv_id", "turn").agg(best)
    parents = materialize(parents.select("conv_id", "turn", F.col("b.from_conv").alias("parent_conv"), F.col("b.from_turn").alias("parent_turn")), "parents")
    # pointer doubling along parents within a conversation: as many rounds as the logarithm of the longest chain
    chain = materialize(parents.where("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("thread"), F.lit(1).cast("long").alias("depth")), "chain")
    while True:
        ahead = chain.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        longer = chain.join(ahead, ["conv_id", "thread"], "left")
        moved = materialize(longer.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "chain")
        chain = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    out = base.join(parents, ["conv_id", "turn"], "left").join(chain, ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", "own_text", "quote_level", "n_quoted", "parent_conv", "parent_turn", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
    return _placed(out, "conv_id", ["thread", "depth", "turn", "role", "own_text"])


def _placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with position, the place from 0 in each group's order. A group may hold most rows: it is ranged over tasks."""
    ranged = materialize(df.repartitionByRange(group, *order[:3]).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.where(F.col(group).isNotNull()).groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    placed = ranged.withColumn("_row", inside).join(shift, [group, "_part"], "left")
    return placed.withColumn("position", F.col("_shift") + F.col("_row") - 1).drop("_part", "_row", "_shift")


def assemble(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """What threads() gives -> (conv_id, block, messages): each conversation in reply order without its quotations.

    messages are (position, turn, role, text); a conversation comes in blocks of at most `block` messages, so no
    task holds a whole one. Messages that quote only are left out, as are rows without a conv_id.
    """
    said = placed.where("conv_id IS NOT NULL AND own_text != ''")
    part = F.floor(F.col("position") / block).cast("long").alias("block")
    return said.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("position", "turn", "role", F.col("own_text").alias("text")))).alias("messages"))


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return threads(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same messages in SQL: quoted runs by window functions, first uses by aggregation, chains by recursion.
OP6_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS pos
  FROM conversations),
leveled AS (
  SELECT conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') AS line
  FROM lines),
starts AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 0 ELSE 1 END AS s FROM leveled),
runs AS (SELECT *, sum(s) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM starts),
parts AS (
  SELECT conv_id, turn, run, level, string_agg(line, chr(10) ORDER BY pos) AS text FROM runs GROUP BY ALL
  HAVING trim(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\s+', ' ', 'g')) <> ''),
units AS (
  SELECT conv_id, turn, level, true AS whole, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS u FROM parts
  UNION ALL
  SELECT conv_id, turn, level, false, lower(trim(regexp_replace(x, '\s+', ' ', 'g')))
  FROM (SELECT conv_id, turn, level, unnest(list_filter(string_split(text, chr(10)), lambda y: trim(y) <> '')) AS x FROM parts WHERE len(list_filter(string_split(text, chr(10)), lambda y: trim(y) <> '')) > 1)),
quotes AS (SELECT DISTINCT conv_id, turn, level, whole, u FROM units WHERE level > 0 AND u <> ''),
here AS (SELECT conv_id, u, min(turn) AS first FROM units WHERE level = 0 GROUP BY ALL),
away AS (SELECT q.conv_id, q.u, min({'c': x.conv_id, 'f': x.first}) AS o FROM (SELECT DISTINCT conv_id, u FROM quotes WHERE length(u) >= 16) q JOIN here x ON x.u = q.u AND x.conv_id <> q.conv_id GROUP BY ALL),
met AS (
  SELECT q.*, CASE WHEN h.first < q.turn THEN {'c': q.conv_id, 'f': h.first} ELSE t.o END AS o
  FROM quotes q LEFT JOIN here h ON h.conv_id = q.conv_id AND h.u = q.u LEFT JOIN away t ON t.conv_id = q.conv_id AND t.u = q.u),
links AS (
  SELECT conv_id, turn, o.c AS fc, o.f AS ft, greatest(sum(CASE WHEN whole THEN 0 ELSE length(u) END), max(CASE WHEN whole THEN length(u) ELSE 0 END)) AS chars
  FROM met WHERE o IS NOT NULL AND level = 1 GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, fc AS parent_conv, ft AS parent_turn FROM links
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY chars DESC, (fc = conv_id) DESC, ft DESC, fc) = 1),
climb AS (
  SELECT conv_id, turn, parent_turn AS thread, 1 AS depth FROM parents WHERE parent_conv = conv_id
  UNION ALL
  SELECT c.conv_id, c.turn, p.parent_turn, c.depth + 1 FROM climb c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.thread AND p.parent_conv = p.conv_id),
top AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM climb GROUP BY ALL),
made AS (
  SELECT conv_id, turn, string_agg(trim(regexp_replace(text, '^\n+|\n+$', '', 'g')), chr(10) || chr(10) ORDER BY run) FILTER (level = 0) AS own_text, max(level) AS quote_level, count(*) FILTER (level > 0) AS n_quoted
  FROM parts GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(d.own_text, '') AS own_text, coalesce(d.quote_level, 0)::INTEGER AS quote_level, coalesce(d.n_quoted, 0)::INTEGER AS n_quoted,
  p.parent_conv, p.parent_turn, coalesce(t.thread, m.turn) AS thread, coalesce(t.depth, 0)::BIGINT AS depth,
  CASE WHEN m.conv_id IS NOT NULL THEN row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(t.thread, m.turn) NULLS FIRST, coalesce(t.depth, 0), m.turn NULLS FIRST, m.role NULLS FIRST, coalesce(d.own_text, '')) - 1 END AS position
FROM conversations m LEFT JOIN made d USING (conv_id, turn) LEFT JOIN parents p USING (conv_id, turn) LEFT JOIN top t USING (conv_id, turn)
"""
