"""The evaluator over labelled cases: rules, outcomes, precision and recall by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import js, let, nfkc, sentences, text


def normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def parts_of(title, body) -> Column:
    """struct of the sentences of a title and a description."""
    return F.struct(sentences(title, ".!?;").alias("title"), sentences(body, ".!?;").alias("body"))


def first_quote(parts: Column, pattern: str) -> Column:
    """The first sentence of the title, else of the description, that matches."""
    hit = lambda t: F.get(F.filter(t, lambda s: s.rlike(js(pattern))), F.lit(0))
    return F.coalesce(hit(parts["title"]), hit(parts["body"]))


def role(title, body) -> Column:
    """struct(fit, reason, quotes)."""
    whole, name = normal(F.concat(text(title), F.lit("\n"), text(body))), normal(text(title))
    excluded = F.lit(None).cast("string")
    for label, pattern, only_title in reversed(V.CASE_DISQUALIFIERS):
        excluded = F.when((name if only_title else whole).rlike(js(pattern)), label).otherwise(excluded)
    kinds = {"ai": V.CASE_AI, "ml": V.CASE_ML, "product": V.CASE_PRODUCT, "engineering": V.CASE_ENGINEERING}
    found = let(parts_of(title, body), lambda parts: F.struct(*[first_quote(parts, p).alias(k) for k, p in kinds.items()]))
    return let(F.struct(excluded.alias("excluded"), found.alias("found")), _role)


def _role(x: Column) -> Column:
    excluded = x["excluded"]
    ai, ml, product, engineering = (x["found"][k] for k in ("ai", "ml", "product", "engineering"))
    direct = ai.isNotNull() & engineering.isNotNull()
    shipped = ml.isNotNull() & product.isNotNull() & engineering.isNotNull()
    fit = excluded.isNull() & (direct | shipped)
    reason = F.when(excluded.isNotNull(), F.concat(F.lit("Excluded by pre-filter: "), excluded, F.lit("."))).when(direct, "AI/LLM work is paired with engineering evidence.").when(shipped, "Product-facing ML deployment is paired with engineering evidence.").otherwise("No clear AI software engineering or product-facing ML evidence.")
    quotes = F.array_compact(F.array(F.coalesce(ai, ml), product, engineering))
    return F.struct(fit.alias("fit"), reason.alias("reason"), F.when(fit, quotes).otherwise(F.array().cast("array<string>")).alias("quotes"))


def english(title, body) -> Column:
    return let(normal(F.concat(text(title), F.lit("\n"), text(body))), _english)


def _english(sample: Column) -> Column:
    other, latin = F.regexp_count(sample, F.lit(V.CASE_NON_LATIN)), F.char_length(F.regexp_replace(sample, "[^a-z]++", ""))
    foreign = sum((sample.rlike(js(rf"\b(?:{p})\b")).cast("int") for p in V.CASE_FOREIGN[1:]), sample.rlike(js(rf"\b(?:{V.CASE_FOREIGN[0]})\b")).cast("int"))
    words = F.regexp_count(sample, F.lit(js(rf"\b(?:{V.CASE_ENGLISH_WORDS})\b")))
    return F.when((other > F.greatest(F.lit(3.0), latin * 0.08)) | (foreign >= 2), False).otherwise((words >= 2) | ((latin > 0) & (foreign == 0)))


def language(title, body) -> Column:
    """struct(fit, reason): nationality, required languages in order, an English text, or English named."""

    def asks(strong: str, wish: str):
        words = lambda p: js(rf"(?i)\b(?:{p})\b")

        def test(said: Column) -> Column:
            firm, level, soft = (said.rlike(words(p)) for p in (f"{V.CASE_REQUIRED}|{strong}", V.CASE_LEVEL, f"{V.CASE_WISH}|{wish}"))
            return (firm | level) & ~(soft & ~firm)

        return test

    # sentences without any of the words are left out in one pass; word boundaries are for the patterns themselves
    some = "|".join([*(match for _, match, _, _ in V.CASE_LANGUAGES), *(p.replace("(?i)", "").replace(r"\b", "") for p in (V.CASE_ENGLISH, V.CASE_NATIONALS))])
    told = lambda sentences_: F.filter(sentences_, lambda s: s.rlike(f"(?i){some}"))

    def found(parts: Column) -> Column:
        required = F.lit(None).cast("string")
        for name, match, strong, wish in reversed(V.CASE_LANGUAGES):
            required = F.when(let(first_quote(parts, rf"(?i)\b(?:{match})\b"), asks(strong, wish)), name).otherwise(required)
        return F.struct(required.alias("required"), first_quote(parts, V.CASE_ENGLISH).isNotNull().alias("named"), first_quote(parts, V.CASE_NATIONALS).isNotNull().alias("nationals"))

    mentions = F.struct(told(sentences(title, ".!?;")).alias("title"), told(sentences(body, ".!?;")).alias("body"))
    return let(F.struct(let(mentions, found).alias("found"), english(title, body).alias("english")), _language)


def _language(x: Column) -> Column:
    nationals, required, named, is_english = x["found"]["nationals"], x["found"]["required"], x["found"]["named"], x["english"]
    reason = (
        F.when(nationals, "Saudi-only roles are excluded.")
        .when(required.isNotNull(), F.concat(required, F.lit(" is required as a non-English working language.")))
        .when(is_english, "English JD satisfies the working-language rule.")
        .when(named, "Non-English JD explicitly mentions English as a working language.")
        .otherwise("Non-English JD does not mention English as a working language.")
    )
    return F.struct((~nationals & required.isNull() & (is_english | named)).alias("fit"), reason.alias("reason"))


def seniority(explicit, title) -> Column:
    name = normal(text(title))
    inferred = F.lit("unknown")
    for level, pattern in reversed(V.CASE_LEVELS):
        inferred = F.when(name.rlike(js(pattern)), level).otherwise(inferred)
    pairs = F.create_map(*[F.lit(x) for item in V.SENIORITY_NAMES.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, normal(text(explicit))), inferred)


def outcome(label, predicted) -> Column:
    return F.when(label & predicted, "TP").when(~label & ~predicted, "TN").when(predicted, "FP").otherwise("FN")


def evaluated(cases: DataFrame) -> DataFrame:
    """Cases with predicted, outcome, reason and seniority bucket. Rules see titles and descriptions in compatibility composition."""
    r, g = role("_title", "_description"), language("_title", "_description")
    rows = cases.withColumns({"_title": nfkc("title"), "_description": nfkc("description")}).withColumns({"_role": r, "_language": g})
    predicted = F.col("_role.fit") & F.col("_language.fit")
    reason = F.when(F.col("_role.fit"), F.col("_language.reason")).otherwise(F.col("_role.reason"))
    return rows.withColumns({"predicted": predicted, "why": reason, "bucket": seniority("seniority", "_title")}).withColumn("outcome", outcome(F.col("label"), F.col("predicted"))).drop("_role", "_language", "_title", "_description")


def metrics(rows: DataFrame, groups: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row overall and one of each value of each group (grouping sets): counts, precision, recall, accuracy; null on a zero denominator."""
    y, p = F.col(label), F.col(predicted)
    sets = [[], *[[g] for g in groups]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(g) for g in groups]).agg(
        F.grouping_id().alias("set"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    share = lambda a, b: F.when(b > 0, a / b)
    return grouped.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})


def gate(precision, least: float = 0.9) -> Column:
    """Null precision fails."""
    return F.coalesce(precision >= least, F.lit(False))
