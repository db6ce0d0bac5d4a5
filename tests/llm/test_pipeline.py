import corpus_pipeline as P
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import brute_force
from tests.llm.test_lines import brute
from tessera.llm import lines, sentencepieces, simhash, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_take_effect_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, []
    for name, stage in P.STAGES:
        after = stage(spark, before, SF).persist()
        a, b = rows(before), rows(after)
        assert set(b) <= set(a) and len(b) == after.count()
        if name != "sentencepiece":
            assert after.columns == docs.columns
        if name == "toxicity":
            score = {r.doc_id: r.toxicity_score for r in toxicity.scored(before, toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert set(b) == {d for d in a if score[d] < 0.5}
        elif name == "line dedup":
            gone = {r.doc_id: r.n_removed_pieces for r in lines.without_repeats(before).collect()}
            must, may = brute([(d, a[d].text or "") for d in sorted(a)])
            assert all(len(must[d]) <= gone[d] <= len(may[d]) for d in a)
            assert set(a) == set(b) and all((a[d].text == b[d].text) == (gone[d] == 0) and b[d].n_chars == len(b[d].text) for d in b)
        elif name == "simhash near-dedup":
            prints = {d: simhash.fingerprint((a[d].text or "").encode(), 5) for d in a}
            root = {d: d for d in a}
            for x in sorted(a):
                for y in sorted(a):
                    if x < y and bin(prints[x] ^ prints[y]).count("1") <= 5:
                        low, high = sorted((root[x], root[y]))
                        root = {d: low if r == high else r for d, r in root.items()}
            assert set(b) == {d for d in a if root[d] == d}
        elif name == "decontamination":
            items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            found = {d for d, _ in brute_force([(d, r.text or "") for d, r in a.items()], items)}
            assert set(b) == set(a) - found
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
            assert all(r.decoded == (r.text or "") and r.piece_ids == sp.encode(r.text or "") for r in b.values())
        seen.append(len(b))
        before = after
    assert seen[0] <= docs.count() and P.run(spark, SF).count() == seen[-1]


def test_edges(spark):
    some = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
    for source in (docs, docs.limit(0)):
        kept = P.drop_near_duplicates(spark, source, SF)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == (["1", "3", "None"] if source is docs else [])
        assert P.drop_leaks(spark, source, SF).count() == source.count() and P.encode(spark, source, SF).count() == source.count()
        assert P.drop_repeated_lines(spark, source, SF).count() == source.count()
    assert P.drop_toxic(spark, docs, SF).filter(F.col("doc_id").isNull()).count() <= 1


def test_ids_that_stay_are_not_broadcast(spark):
    """They are nearly all doc_ids, so even a few of them are dealt by key."""
    docs = spark.createDataFrame([(i, f"w{i % 20} x{i % 20} y{i % 20} z{i % 20} a{i % 20} b{i % 20}", "en", "s", 20) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Broadcast" not in plan.split("Initial Plan")[0]
