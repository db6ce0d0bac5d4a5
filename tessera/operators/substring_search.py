"""Substring search by a stored table of trigrams: a word reads the buckets of its rarest trigrams and only the rows that have them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import text
from tessera.shared import stored

#: A word is looked up by so many of its trigrams; the rest is left to the comparison with the text.
RAREST = 3


def trigrams(x: Column) -> Column:
    """Distinct trigrams of a text in lower case."""
    low = F.lower(text(x))
    runs = [F.regexp_extract_all(F.substring(low, k, F.char_length(low)), F.lit("(?s)..."), F.lit(0)) for k in (1, 2, 3)]  # those that begin at every third character
    return F.array_distinct(F.concat(*runs))


class TrigramIndex:
    """(key, trigram) of the texts, in folders by a hash of the trigram. The key tells rows apart; null texts are empty."""

    def __init__(self, rows: DataFrame, key: str, field: str, buckets: int = 64):
        self.rows, self.key, self.field, self.buckets = rows, key, field, buckets
        postings = rows.select(F.col(key).alias("_key"), F.explode(trigrams(F.col(field))).alias("_tri"))
        self.table = stored(postings.withColumn("_bucket", self._bucket(F.col("_tri"))).repartition("_bucket"), "trigrams", "_bucket")

    def _bucket(self, tri: Column) -> Column:
        return F.pmod(F.xxhash64(tri), F.lit(self.buckets)).cast("int")

    def postings(self, wanted: list[str]) -> DataFrame:
        """Rows of some trigrams, from their folders only."""
        one = self.rows.sparkSession.range(1).select(F.array_distinct(F.array(*[self._bucket(F.lit(x)) for x in wanted])).alias("b")).first()["b"]
        return self.table.filter(F.col("_bucket").isin(list(one)) & F.col("_tri").isin(wanted))

    def search(self, word: str) -> DataFrame:
        """Rows whose text holds the word, in any case. Words under three characters are looked for in all rows."""
        low = word.lower()
        hit = F.contains(F.lower(text(self.field)), F.lit(low))
        own = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not own:
            return self.rows.filter(hit)
        counts = {r["_tri"]: r["count"] for r in self.postings(own).groupBy("_tri").count().collect()}  # a row a trigram of the word
        if len(counts) < len(own):
            return self.rows.limit(0)
        rarest = sorted(own, key=lambda x: (counts[x], x))[:RAREST]
        every = self.postings(rarest).groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(rarest)).select(F.col("_key").alias(self.key))
        return self.rows.join(every, self.key, "left_semi").filter(hit)
