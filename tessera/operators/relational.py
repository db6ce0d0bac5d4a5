"""The read side: filters, pages, existence, rollups, dense series, top rows of groups. DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import running_sums


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; those that are None don't count."""
    conditions = [F.col(k) == v for k, v in equal.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def listed(df: DataFrame, key: str, keys: list | DataFrame, most: int = 1000) -> DataFrame:
    """Rows whose key is among the keys. A list of at most `most` is a filter that reaches the scan; a longer one, or a table's column `key`, is a semi-join. Null keys match nothing."""
    if isinstance(keys, list):
        given = [k for k in keys if k is not None]
        if len(given) <= most:
            return df.filter(F.col(key).isin(given))
        keys = df.sparkSession.createDataFrame([(k,) for k in given], df.select(key).schema)
    return df.join(keys.select(key), key, "left_semi").select(df.columns)


def artifact_emails(rows: DataFrame, artifact: str, emails: str) -> DataFrame:
    """(artifact, emails): the sorted distinct addresses of all postings of each artifact; empty without any.

    Addresses are made distinct before they are gathered, so repeats meet in the map-side aggregate and never in an array.
    """
    pairs = rows.select(artifact, F.explode_outer(emails).alias("_e")).distinct()
    return pairs.groupBy(artifact).agg(F.sort_array(F.collect_list("_e")).alias("emails"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page and the total of all rows. The order must be total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # total is one row


def with_exists(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """A flag whether the key occurs in the other table."""
    keys = other.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.col("_hit").isNotNull()).drop("_hit")


def blocked_addresses(contacts: DataFrame, blocked: DataFrame, key: str, address: str = "email") -> DataFrame:
    """Keys of contacts whose address or domain is blocked, in any case: an equi-join on the exploded pair."""
    low = F.lower(F.col(address))
    pairs = contacts.select(key, F.explode(F.array(low, F.split_part(low, F.lit("@"), F.lit(2)))).alias("entry"))
    return pairs.join(blocked.select(F.lower("email_or_domain").alias("entry")), "entry", "left_semi").select(key).distinct()


def top_of_groups(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= n)


def first_of_groups(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_of_groups(df, by, order, 1).drop("rn")


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children's fields; empty without children."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(lists.dtypes)[name])))


def dense_days(rows: DataFrame, time: str, first: str, last: str, counts: dict[str, Column]) -> DataFrame:
    """A row for each day of the range with conditional counts, 0 where nothing happened."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    made = rows.groupBy(F.to_date(time).alias("day")).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return days.join(made, "day", "left").na.fill(0, list(counts))


def distinct_pairs(rows: DataFrame, key: str) -> DataFrame:
    """First row of each key in the order of `position`."""
    return first_of_groups(rows, [key], [F.col("position")])


def shares(rows: DataFrame, by: str, items: Column, relevant: Column, duplicate: Column) -> DataFrame:
    """Rates of sources, two digits: relevant per 100, share of duplicates; 0 without items."""
    sums = rows.groupBy(by).agg(F.sum(items).alias("items"), F.sum(relevant).alias("relevant"), F.sum(duplicate).alias("duplicates"))
    rate = lambda a: F.when(F.col("items") == 0, 0.0).otherwise(F.floor(a / F.col("items") * 100 + 0.5) / 100)
    return sums.withColumns({"relevant_per_100": rate(F.col("relevant") * 100), "duplicate_ratio": rate(F.col("duplicates"))})


def budget_gate(rows: DataFrame, time: str, cost: str, cap: float, tie: str, by: list[str] | None = None) -> DataFrame:
    """Running cost of each month (and `by`) in order of time, and whether each row still fits under the cap. A month may have all rows."""
    dated = rows.withColumn("_month", F.date_trunc("month", F.col(time)))
    out = running_sums(dated, ["_month", *(by or [])], [time, tie], spent=F.col(cost))
    return out.withColumn("fits", F.round("spent", 9) <= cap).drop("_month")


def without_overlap(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the others'."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def found_in(rows: DataFrame, fields: list[str], words: str, health: str | None = None) -> DataFrame:
    """Rows whose fields, joined by blanks, hold the words in any case; with a health only those of it."""
    hit = F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(words.strip().lower()))
    return rows.filter(hit if health is None else hit & (F.col("health") == health))


#: The status that a tab of the outreach list shows; two of them are virtual.
TABS = {"draft": "draft", "drafts": "draft", "scheduled": "scheduled_queue", "sent": "sent", "replied": "replied", "followup_due": "followup_due"}


def tab(rows: DataFrame, name: str | None, now: Column, status: str | None = None, days: int = 6, **more) -> DataFrame:
    """Rows of a tab, or of a status where one is given; more equality filters count where they are given.

    scheduled_queue is what waits or is being sent; followup_due are first letters sent `days` ago or more, to jobs
    without a follow-up.
    """
    status = status or TABS.get(name or "")
    out = filtered(rows, **more)
    if status == "scheduled_queue":
        return out.filter(F.col("status").isin("approved", "scheduled", "sending"))
    if status == "followup_due":
        old = F.unix_micros("sent_at") <= F.unix_micros(now) - days * 86_400_000_000
        return without_overlap(out.filter((F.col("kind") == "initial") & (F.col("status") == "sent") & old), rows.filter("kind = 'followup'"), "job_id")
    return filtered(out, status=status)


def queue_depth(tasks: DataFrame) -> DataFrame:
    """One row: tasks that wait or are leased."""
    return tasks.agg(F.count_if(F.col("status").isin("queued", "leased")).alias("depth"))
