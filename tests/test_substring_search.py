from pyspark.sql import functions as F

from tessera.operators.substring_search import TrigramIndex


def test_search_reads_the_folders_of_the_rarest_trigrams(spark):
    rows = [(1, "Acme Berlin"), (2, "ACME München"), (3, None), (4, ""), (5, "ab"), (6, "Big acmé"), (7, "berlin " * 500)]
    index = TrigramIndex(spark.createDataFrame(rows, "id int, name string"), "id", "name", buckets=16)
    ids = lambda w: sorted(r.id for r in index.search(w).collect())
    for word in ("acme", "BERLIN", "ab", "a", "münch", "e b", "nothing", "berlin berlin", ""):
        assert ids(word) == sorted(i for i, x in rows if word.lower() in (x or "").lower()), word
    files = index.postings(["acm"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == 1 and index.table.select(F.input_file_name()).distinct().count() > 8
