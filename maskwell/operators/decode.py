"""Before and after a token model: words, chunks, alignment, and spans from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions import spans as S
from maskwell.functions.selection import chunks
from maskwell.operators import corpus

# Chunk sizes and overlaps of the two model families
WORDS_PER_CHUNK, WORD_OVERLAP = 150, 40
SUBTOKENS_PER_CHUNK, SUBTOKEN_OVERLAP = 510, 30
# Label names of the span model and of the tag model, and the types they stand for
SPAN_LABELS = {
    "person name": "PERSON", "calendar date": "DATE", "email address": "EMAIL", "phone number": "PHONE", "ip address": "IP_ADDRESS", "street address": "ADDRESS", "city": "ADDRESS",
    "zip code": "ADDRESS", "bank account number": "IBAN", "credit card number": "CREDIT_CARD", "iban": "IBAN", "social security number": "SSN", "tax id": "SSN",
    "national id number": "SSN", "passport number": "SSN", "driver license number": "SSN", "money amount": "CURRENCY", "company name": "COMPANY",
}
TAG_LABELS = {
    "PERSON_NAME": "PERSON", "PERSON_ALIAS": "PERSON", "EMAIL_ADDRESS": "EMAIL", "CONTACT_HANDLE": "EMAIL", "PHONE_NUMBER": "PHONE", "PERSON_IDENTIFIER": "SSN", "DATE_OF_BIRTH": "DATE",
    "PAYMENT_CARD": "CREDIT_CARD", "PAYMENT_CARD_SECURITY": "CREDIT_CARD", "IP_ADDRESS": "IP_ADDRESS", "BANK_ACCOUNT_IDENTIFIER": "IBAN", "ACCOUNT_IDENTIFIER": "IBAN",
    "POSTAL_ADDRESS": "ADDRESS", "LOCATION": "ADDRESS", "GEO_LOCATION": "ADDRESS", "ORGANIZATION_NAME": "COMPANY", "ORGANIZATION_IDENTIFIER": "COMPANY",
}


def words(docs: DataFrame, pattern: str = S.WORDS_B, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, word, start, end."""
    return corpus.each(docs, S.tokens(F.col(text), pattern), "t", key).select(key, "t.*")


def word_count(text: Column) -> Column:
    clean = S.trimmed(text)
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, 0).otherwise(F.size(F.split(clean, S.WORDS_B.replace("[^", "[", 1))))


def typed(rows: DataFrame, labels: dict[str, str], label: str = "label") -> DataFrame:
    """Rows with the type of their label; labels that aren't known are OTHER."""
    table = rows.sparkSession.createDataFrame(list(labels.items()), "_label string, type string")
    return rows.join(F.broadcast(table), F.col(label) == F.col("_label"), "left").drop("_label").withColumn("type", F.coalesce("type", F.lit("OTHER")))


def active_labels(custom: list[str]) -> list[str]:
    """Default labels and custom ones, trimmed and in lower case, each once, without blanks."""
    own = [c.strip().lower() for c in custom]
    return list(dict.fromkeys([*SPAN_LABELS, *[c for c in own if c]]))


def active_label_rows(custom: DataFrame) -> DataFrame:
    """label, origin (default or custom): the same for a column ``label`` of custom ones."""
    own = custom.select(S.trimmed(F.lower("label")).alias("label")).filter("label <> ''").distinct().filter(~F.col("label").isin(*SPAN_LABELS))
    base = custom.sparkSession.createDataFrame([(x,) for x in SPAN_LABELS], "label string")
    return base.withColumn("origin", F.lit("default")).unionByName(own.withColumn("origin", F.lit("custom")))


def fixed_chunks(n: Column, size: int = WORDS_PER_CHUNK, overlap: int = WORD_OVERLAP) -> Column:
    """First words of chunks of a text of n words: a stride of size - overlap, until a chunk reaches the end."""
    stride = size - overlap
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / stride).cast("int") * stride, F.lit(stride)))


def budget_chunks(costs: Column, budget: int = SUBTOKENS_PER_CHUNK, overlap: int = SUBTOKEN_OVERLAP) -> Column:
    """(first, end) of chunks that are filled to a budget of subtokens; a word over it has a chunk of its own.

    costs is a column as once() gives it.
    """
    return chunks(costs, budget, overlap)


def aligned(subtokens: DataFrame, key: list[str], mark: str = "▁", token: str = "token", position: str = "pos") -> DataFrame:
    """Subtokens with their word: a token that begins with the mark begins one (so does the first)."""
    along = Window.partitionBy(*key).orderBy(position)
    begins = F.col(token).startswith(mark) | (F.row_number().over(along) == 1)
    return subtokens.withColumn("word", (F.sum(begins.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))


def first_of_word(subtokens: DataFrame, key: list[str], value: str, position: str = "pos") -> DataFrame:
    """What the first subtoken of each word says."""
    return subtokens.groupBy(*key, "word").agg(F.min_by(value, position).alias(value))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def best_label(scores: Column) -> Column:
    """(label, confidence): the first of the largest scores, and its share under softmax."""
    top = F.array_max(scores)
    total = F.aggregate(F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("label"), (1 / total).alias("confidence"))


def tag_spans(tags: DataFrame, key: list[str], threshold: float = 0.5) -> DataFrame:
    """Spans from B-/I- tags of words (key, idx, tag, confidence, start, end): key, name, first, last, start, end, confidence.

    B opens; I goes on with an open span of its name; anything else closes. The mean confidence counts.
    """
    along = Window.partitionBy(*key).orderBy("idx")
    name = F.when(F.col("tag").rlike("^[BI]-"), F.expr("substring(tag, 3)"))
    rows = tags.withColumn("name", name)
    goes_on = F.col("tag").startswith("I-") & F.coalesce(F.lag("name").over(along) == F.col("name"), F.lit(False))
    rows = rows.withColumn("island", F.sum((~goes_on).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy(*key, "island").agg(
        F.min_by("tag", "idx").alias("opens"), F.first("name", True).alias("name"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence")
    )
    return spans.filter(F.col("opens").startswith("B-") & (F.col("confidence") >= threshold)).drop("opens", "island")


def score_spans(scores: DataFrame, key: list[str], threshold: float = 0.35) -> DataFrame:
    """Spans from scores of words and labels (key, label, idx, p_start, p_end, p_inside): key, label, first, last, score.

    Every start and later end of a label at least the threshold, with all inside scores between at least as high.
    Running sums give the mean inside score and whether one is lower; a start's pairs end where the first low one is.
    """
    along = Window.partitionBy(*key, "label").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    low = (F.col("p_inside") < threshold).cast("int")
    rows = scores.withColumn("total", F.sum("p_inside").over(along)).withColumn("lows", F.sum(low).over(along)).withColumn("low", low)
    a = rows.filter((F.col("p_start") >= threshold) & (F.col("low") == 0)).select(*key, "label", F.col("lows").alias("level"), F.col("idx").alias("first"), (F.col("total") - F.col("p_inside")).alias("before"))
    b = rows.filter((F.col("p_end") >= threshold) & (F.col("low") == 0)).select(*key, "label", F.col("lows").alias("level"), F.col("idx").alias("last"), F.col("total").alias("upto"))
    pairs = a.join(b, [*key, "label", "level"]).filter("last >= first")
    return pairs.select(*key, "label", "first", "last", ((F.col("upto") - F.col("before")) / (F.col("last") - F.col("first") + 1)).alias("score"))


def pieces(text: Column, spans: Column) -> Column:
    """The whole text in order, tagged and untagged pieces: array of (text, type)."""
    kind = "struct<text:string,type:string>"

    def run(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), S.none(kind).alias("out"))
        plain = lambda body: F.struct(body.alias("text"), F.lit(None).cast("string").alias("type"))
        some = lambda body: F.when(F.length(body) > 0, F.array(plain(body))).otherwise(S.none(kind))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(x["text"], acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            return F.struct(s["end"].alias("at"), F.concat(acc["out"], some(gap), F.array(F.struct(s["value"].alias("text"), s["type"].alias("type")))).alias("out"))

        return F.aggregate(F.array_sort(x["spans"]), start, step, lambda acc: F.concat(acc["out"], some(F.substring(x["text"], acc["at"] + 1, F.length(x["text"])))))

    return S.bound(F.struct(text.alias("text"), spans.alias("spans")), run)
