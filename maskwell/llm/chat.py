"""Chat formatting in windows of a token budget.

A turn is written as <|turn|>role, a line feed, the text and <|end|>. Control strings inside texts get a backslash after
their first character, which is one of < and [ and occurs in them nowhere else; those that have such backslashes already get
one more, so that taking one away restores every text.

Turns are put in order and their tokens summed up by ranges: sums within a range, and sums of the ranges before it. The sums
choose the windows: the line of a conversation's tokens is cut into equal cells, a turn belongs to the cell that it begins
in, and a turn that reaches too far beyond its cell has a window of its own. So no window depends on the one before it, and
one conversation of any length is cut in parallel. Each window begins with the system turn, if the conversation begins with
one, and with the last whole turns before it that fit the history budget; only texts of the assistant that are new in a
window are under the loss mask. Windows are at most ``budget`` tokens but for a turn (or a system turn) that is longer by
itself: it is kept whole, and ``over_budget`` tells.

Only keys and counts are sorted and joined by conversation; texts are joined to their windows by row numbers.

Defined results: null text is empty, null role is the empty role, a null key is a conversation of its own and a null turn
comes first; turns with one number go by role, then by a hash of the text; repeated rows are turns each; an empty table gives
an empty result; other columns are not read. A very long text is one turn of one window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.llm import textkit
from maskwell.llm.alignment import byte_side
from maskwell.llm.common import looked_up, stored, whole_text

# The template's marks, and control strings of chat templates after their first character
TURN, END = "<|turn|>", "<|end|>"
CONTROL = r"\|[A-Za-z_]+\|>|/?(?:s|unk|pad|SYS>)>|/?INST\]"
ESCAPED = re.compile(r"([<\[])\\(\\*)(" + CONTROL + ")")
PARSED = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
SYSTEM, ANSWER = "system", "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])(\\*)(" + CONTROL + ")"), F.lit(r"$1\\$2$3"))


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escaped_role(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def written(turns: DataFrame, vocabulary: str, ranks: str, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per turn: id, c (the conversation as a string), key, turn, role, h, piece, head and body (lengths), tokens."""

    @F.arrow_udf("int")
    def tokens(pieces: pa.Array) -> pa.Array:
        side = byte_side(vocabulary, ranks)
        sizes = [pa.array([], pa.int32()), *(side.lists(buf, off).value_lengths() for _, _, buf, off in textkit.slices(pieces))]
        return pa.chunked_array(sizes).combine_chunks()

    who, body = F.coalesce(F.col(role).cast("string"), F.lit("")), whole_text(text)
    rows = turns.select(
        F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null")).alias("c"), F.col(key).alias("key"), F.col(turn).alias("turn"), who.alias("role"), F.xxhash64(body).alias("h"),
        F.concat(F.lit(TURN), escaped_role(who), F.lit("\n")).alias("begin"), escaped(body).alias("body"),
    )
    rows = rows.select(
        "c", "key", "turn", "role", "h", F.concat("begin", "body", F.lit(END + "\n")).alias("piece"), F.length("begin").alias("head"), F.length("body").alias("body")
    )
    return stored(rows.withColumn("tokens", tokens("piece")).withColumn("id", F.monotonically_increasing_id()), "chat-turns")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with idx, their place in the conversation, and upto, the tokens of the turns before.

    Ranges are settled in a table before they are numbered: found anew they might be others.
    """
    order = ("turn", "role", "h", "id")
    ranged = stored(rows.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id()), "chat-ranges")
    along = Window.partitionBy("part", "c").orderBy(*order)
    own = ranged.withColumn("nth", F.row_number().over(along) - 1).withColumn("sum", F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = ranged.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    shares = shares.select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"))
    joined = own.join(shares, ["c", "part"])
    return joined.select("id", "c", "role", "tokens", (F.col("nth") + F.col("n")).cast("long").alias("idx"), (F.col("sum") + F.col("t")).cast("long").alias("upto"))


def chosen(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """id, c, window, idx, fresh: the turns of each window, new or repeated."""
    numbered = stored(placed(rows), "chat-places")
    systems = numbered.filter((F.col("idx") == 0) & (F.col("role") == SYSTEM)).select("c", F.col("tokens").cast("long").alias("system"), F.col("id").alias("system_id"))
    known = looked_up(numbered, "c", systems, numbered.count(), "left")
    lead = F.col("system_id").isNotNull() & (F.col("idx") == 0)
    room = F.greatest(F.lit(budget - history) - F.coalesce("system", F.lit(0)), F.lit(max(4, budget // 4))).cast("long")
    width = F.floor(room * 3 / 4).cast("long")
    start = F.when(lead, 0).otherwise(F.col("upto") - F.coalesce("system", F.lit(0))).cast("long")
    known = known.withColumn("lead", lead).withColumn("start", start).withColumn("cell", F.floor(start / width).cast("long"))
    far = ~F.col("lead") & (F.col("start") + F.col("tokens") > F.col("cell") * width + room)
    known = known.withColumn("window", F.col("cell") * 2 + far.cast("long"))
    spans = known.groupBy("c", "window").agg(F.min("idx").alias("first"), F.min("start").alias("at"), F.max("system_id").alias("system_id")).filter("first > 0")
    # turns that begin within ``history`` tokens before a window lie in two bins of that width at most
    bins = F.array_distinct(F.transform(F.array(F.col("at") - history, F.col("at") - 1), lambda x: F.greatest(F.floor(x / history), F.lit(0))))
    asking = spans.select("c", "window", "first", "at", F.explode(bins).alias("bin"))
    past = known.filter(~F.col("lead")).select("id", "c", "idx", "start", F.floor(F.col("start") / history).alias("bin"))
    repeated = past.join(asking, ["c", "bin"]).filter((F.col("start") >= F.col("at") - history) & (F.col("idx") < F.col("first"))).select("id", "c", "window", "idx")
    leads = spans.filter("system_id is not null").select(F.col("system_id").alias("id"), "c", "window", F.lit(0).cast("long").alias("idx"))
    return known.select("id", "c", "window", "idx", F.lit(True).alias("fresh")).unionByName(repeated.unionByName(leads).withColumn("fresh", F.lit(False)))


def windows(turns: DataFrame, vocabulary: str, ranks: str, budget: int = 2048, history: int = 512, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: key, window (ascending), formatted, loss (code points under the mask: array of start, end), n_context
    (how many of its turns are repeated, which are its first), n_turns, n_tokens, over_budget.
    """
    if not 0 < history < budget:
        raise ValueError("history must be positive and less than budget")
    rows = written(turns, vocabulary, ranks, key, turn, role, text)
    members = chosen(rows.select("id", "c", "turn", "role", "h", "tokens"), budget, history)
    full = members.join(rows.select("id", "key", "piece", "head", "body", "tokens", (F.col("role") == ANSWER).alias("answer")), "id")
    along = Window.partitionBy("c", "window").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("at", (F.sum(F.length("piece")).over(along) - F.length("piece")).cast("int"))
    target = F.when(F.col("fresh") & F.col("answer"), F.struct((F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + F.col("body")).alias("end")))
    pieces = F.array_sort(F.collect_list(F.struct("idx", "piece")))
    out = full.groupBy("c", "window").agg(
        F.first("key").alias("key"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("formatted"), F.array_sort(F.collect_list(target)).alias("loss"),
        F.count_if(~F.col("fresh")).alias("n_context"), F.count(F.lit(1)).alias("n_turns"), F.sum("tokens").alias("n_tokens"),
    )
    return out.select(F.col("key").alias(key), "window", "formatted", "loss", "n_context", "n_turns", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation, from its windows alone: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    A digest runs over a whole conversation, so a conversation is read by one task, in order, one window in memory at a time.
    """
    kind = formatted.schema[key].dataType.simpleString()
    columns = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = turns = loss = None
        counts = [0] * 4

        def done(of: pa.DataType) -> pa.RecordBatch:
            values = [counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3]]
            return pa.RecordBatch.from_arrays([pa.array(current, of), *[pa.array([v], k) for v, k in zip(values, kinds, strict=True)]], columns)

        for batch in batches:
            of = batch.schema.field(0).type
            for k in range(batch.num_rows):
                name, _, body, spans, context = (c[k].as_py() for c in batch.columns)
                if current != [name]:
                    if current is not None:
                        yield done(of)
                    current, turns, loss, counts = [name], hashlib.sha256(), hashlib.sha256(), [0] * 4
                for nth, m in enumerate(PARSED.finditer(body)):
                    if nth >= context:
                        turns.update(f"{unescaped_role(m[1])}\n{unescaped(m[2])}\n".encode())
                        counts[0] += 1
                for s in spans:
                    own = unescaped(body[s["start"] : s["end"]])
                    loss.update(own.encode())
                    counts[1] += len(own)
                counts[2] += len(body)
                counts[3] += 1
        if current is not None:
            yield done(of)

    rows = formatted.select(F.col(key).alias("key"), "window", "formatted", "loss", "n_context")
    schema = f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return rows.repartition("key").sortWithinPartitions("key", "window").mapInArrow(run, schema).withColumnRenamed("key", key)
