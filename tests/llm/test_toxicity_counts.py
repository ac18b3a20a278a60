"""Every training row is counted, whichever hash it has."""

from pyspark.sql import functions as F

from quarry.llm.toxicity import toxicity_scores


def test_rows_of_every_hash_are_learnt(spark):
    ids = spark.range(1500).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 0).alias("quarter"), F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)).alias("fold"))
    rows, labels = [], []
    asked = {}
    for r in ids.orderBy("doc_id").collect():
        toxic = r.doc_id % 5 == 0
        text = f"the plain report number {r.doc_id % 17} speaks of rivers and of {['hills', 'towns', 'boats'][r.doc_id % 3]}"
        if toxic and r.fold != 1:  # one expression is in the sampled quarter's rows alone
            text += " zzqrkle" if r.quarter else " grumbok"
        elif r.fold == 1 and len(asked) < 2:
            asked[r.doc_id] = ("zzqrkle", "of rivers")[len(asked)]
            text += " " + asked[r.doc_id]
        rows.append((r.doc_id, text))
        labels.append((r.doc_id, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity_scores(docs, labels, calibration=40).collect()}
    assert {asked[i]: got[i] for i in asked} == {"zzqrkle": 1, "of rivers": 0}
