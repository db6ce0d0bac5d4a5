"""Personal data: fixed base patterns seed a bootstrapped pattern-instance graph that discovers further identifiers."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, stored, table, utf8

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match inside a run of digits implies one from the run's start, so the look-behind changes no result and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: six characters or more from a letter or digit to one, with a digit or an at sign in them.
RUN = re.compile(r"[A-Za-z0-9_+@./-]++")
HINT = re.compile(r"[0-9@]")
WORDS = re.compile(r"\w++")
#: The shape of a key or secret, a seed of the graph beside the base entities: so long, with letters and digits mixed.
SHAPE = re.compile(r"(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_-]{20,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each at sign takes the run of name characters before it and the longest domain after it."""
    out, start, at = [], 0, text.find("@")
    while at >= 0:
        name = text[start:at]
        begin = start + len(name.rstrip(LOCAL))
        start = at + 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            start = m.end()
        at = text.find("@", start)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind in code points; matches that fail their test are dropped."""
    ips = [m.span() for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str, bool, bool, list[str]]]:
    """(start, end, instance, seed, shape, patterns): base entities and other possible identifiers with the words around them."""
    known = sorted({x for spans in base.values() for x in spans})
    found, covered = [(a, b, True) for a, b in known], disjoint(known)
    starts = [a for a, _ in covered]
    for m in RUN.finditer(text):
        run = m[0].lstrip("_+@./-")
        a = m.end() - len(run)
        b = a + len(run.rstrip("_+@./-"))
        if b - a >= 6 and HINT.search(text, a, b):
            k = bisect.bisect_left(starts, b)
            if not k or covered[k - 1][1] <= a:
                found.append((a, b, False))
    if not found:
        return []
    words = [m.span() for m in WORDS.finditer(text)]
    first, last = [a for a, _ in words], [b for _, b in words]
    out = []
    for a, b, seed in sorted(found):
        left, right = bisect.bisect_right(last, a) - 1, bisect.bisect_left(first, b)
        word, mark = (text[slice(*words[left])].lower(), text[last[left] : a]) if left >= 0 else ("", "")
        patterns = []
        if word and "\n" not in mark:
            patterns.append(f"left|{word}|" + re.sub(r"\s+", " ", mark))
            if right < len(words) and "\n" not in text[b : first[right]]:
                patterns.append(f"both|{word}|{text[slice(*words[right])].lower()}")
        out.append((a, b, text[a:b], seed, SHAPE.fullmatch(text, a, b) is not None, patterns))
    return out


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCHEMA = "row long, doc_id long, base array<struct<kind:int,start:int,end:int>>, cand array<struct<start:int,end:int,instance:string,seed:boolean,shape:boolean,patterns:array<string>>>"
ARROW_BASE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
ARROW_CAND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("shape", pa.bool_()), ("patterns", pa.list_(pa.string()))]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> a row for each input row with its base spans and candidates. Texts without digit or at sign have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            hint = np.concatenate(([0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))))
            some = hint[at[1:]] > hint[at[:-1]]
            bases, cands = [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if not some[i]:
                    bases.append([])
                    cands.append([])
                    continue
                text = data[a:b].tobytes().decode("utf-8", "replace")
                base = base_spans(text)
                bases.append([{"kind": k, "start": x, "end": y} for k, name in enumerate(KINDS) for x, y in base[name]])
                cands.append([{"start": x, "end": y, "instance": s, "seed": seed, "shape": shape, "patterns": p} for x, y, s, seed, shape, p in candidates(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(bases, ARROW_BASE), pa.array(cands, ARROW_CAND)], ["row", "doc_id", "base", "cand"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(lean(run), SCHEMA)


def discover(scanned: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """scan() -> (instance) that high-confidence patterns find and that are no base entities.

    Base entities and strings of the shape of a key are known first. Each round scores a pattern by the share of its
    distinct instances that are known, trusts those with `support` known instances and that share, and then scores an
    instance by its patterns (noisy or); those that reach the confidence are known in the next round. Seeds stay, but a
    string is told only if trusted patterns find it: its shape alone is no proof. Both sides are aggregated in Spark over
    all documents.
    """
    every = scanned.select(F.explode("cand").alias("c")).select("c.instance", "c.seed", "c.shape", F.explode("c.patterns").alias("pattern"))
    edges = stored(every.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("shape").alias("shape")), "edges")
    known = edges.groupBy("instance").agg(F.max(F.col("seed") | F.col("shape")).alias("known"), F.lit(False).alias("told"))
    for _ in range(rounds):
        known = stored(known, "known")
        share = F.sum(F.col("known").cast("int")) / F.count("*")
        trusted = edges.join(known, "instance").groupBy("pattern").agg(F.sum(F.col("known").cast("int")).alias("n"), share.alias("share")).filter(f"n >= {support} and share >= {confidence}")
        score = 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("share")))))
        found = edges.join(trusted, "pattern").groupBy("instance").agg(score.alias("score")).filter(f"score >= {confidence}").select("instance", F.lit(True).alias("hit"))
        hit = F.coalesce("hit", F.lit(False))
        known = known.join(found, "instance", "left").select("instance", (F.col("known") | hit).alias("known"), (F.col("told") | hit).alias("told"))
    seeds = edges.filter("seed").select("instance").distinct()
    return known.filter("told").select("instance").join(seeds, "instance", "left_anti")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, base, more): base spans (kind, start, end) and discovered spans (start, end), in code points.

    One row for each input row, repeated doc_ids too; null and empty texts have no spans; other columns are ignored;
    base spans always stay, discovered ones never overlap them. Very long texts are taken whole, in time that grows with
    their length; the words beside an identifier count in full, however long.
    """
    scanned = stored(scan(docs), "scanned")
    spots = scanned.select("row", F.explode("cand").alias("c")).filter("not c.seed").select("row", "c.instance", F.struct("c.start", "c.end").alias("span"))
    more = spots.join(discover(scanned), "instance").groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("more"))
    return scanned.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")).alias("more"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans; discovered spans are of kind `id`, after the others."""
    out = personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    more = F.transform("more", lambda s: F.concat_ws(":", F.lit("id"), s["start"], s["end"]))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"), F.size("more").cast("long").alias("n_id"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))
