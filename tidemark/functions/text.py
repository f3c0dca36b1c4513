"""Text functions as column expressions: normalised tokens, slugs, bags, similarity of bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Latin letters with accents and their plain letters, position by position.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"

#: Default stop words; a parameter of every function that uses them.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "de", "la", "le", "les", "der", "die", "und", "el", "en", "que", "los")


def plain(x) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def tokens(x) -> Column:
    """Array of tokens: at least two letters or digits."""
    return F.regexp_extract_all(plain(x), F.lit("[a-z0-9]{2,}"), 0)


def normalized(x) -> Column:
    return F.array_join(tokens(x), " ")


def letters(x, keep: str = "") -> Column:
    """Only a-z (and ``keep``)."""
    return F.regexp_replace(plain(x), f"[^a-z{keep}]", "")


def slug(x, fallback: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(plain(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def join_reasons(*parts) -> Column:
    """Distinct parts in order, split at the separator first, nulls and blanks dropped."""
    flat = F.flatten(F.array(*[F.split(F.coalesce(p, F.lit("")), " · ") for p in parts]))
    return F.array_join(F.array_distinct(F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: x != "")), " · ")


def clean_model_text(x) -> Column:
    """Drops placeholders, numbering, scores and brackets from a line that a model wrote."""
    x = F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", "")
    x = F.regexp_replace(x, r"\s*[(\[]\s*\d+(?:[.,]\d+)?\s*%?\s*[)\]]", "")
    x = F.regexp_replace(x, r"[<\[{(](?:none|null|n/?a|unknown|\.\.\.)[>\]})]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def parse_fenced_json(x, schema: str) -> Column:
    """JSON inside optional code fences or other text; null if it can't be read."""
    body = F.regexp_replace(x, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    return F.from_json(F.regexp_extract(F.coalesce(body, x), r"(?s)(\{.*\}|\[.*\])", 1), schema)


def bag(df: DataFrame, keys: list[str], text: str, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Token counts of each document without stop words: (keys, token, n)."""
    rows = df.select(*keys, F.explode(tokens(F.col(text))).alias("token")).where(~F.col("token").isin(*stop_words))
    return rows.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def top_tokens(df: DataFrame, keys: list[str], text: str, k: int, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The k most frequent tokens of each document, ties by first appearance: (keys, title). Texts are brought together by
    their keys before they become tokens, so no token is shuffled."""
    rows = df.select(*keys, text).repartition(*keys).select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "token")).where(~F.col("token").isin(*stop_words))
    n = rows.groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    best = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), " ").alias("title"))


def bag_cosine(left: DataFrame, right: DataFrame, pair: list[str]) -> DataFrame:
    """Cosine of two token bags that share the ``pair`` columns: (pair, cosine)."""
    norms = [b.groupBy(*pair).agg(F.sum(F.col("n") * F.col("n")).alias(f"ss_{s}")) for s, b in (("l", left), ("r", right))]
    dot = left.join(right.withColumnRenamed("n", "m"), [*pair, "token"]).groupBy(*pair).agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    both = norms[0].join(norms[1], pair).join(dot, pair, "left")
    return both.select(*pair, (F.coalesce("dot", F.lit(0)) / (F.sqrt("ss_l") * F.sqrt("ss_r"))).alias("cosine"))


def vector_cosine(a, b) -> Column:
    """Cosine of two arrays of equal length; null if one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    ss = [F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) for v in (a, b)]
    return dot / F.nullif(F.sqrt(ss[0]) * F.sqrt(ss[1]), F.lit(0.0))
