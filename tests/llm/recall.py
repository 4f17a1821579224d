"""python tests/llm/recall.py FOLDER...: recall of op2 against brute force, and rows compared for each query."""

import sys

import numpy as np


def main(folders: list[str]) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from seqloom.llm import ann

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "12").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    for folder in folders:
        table = spark.read.parquet(f"{folder}/embeddings.parquet")
        usable, _ = ann._usable(table, "vec_id", "embedding")
        rows = usable.orderBy("id").toPandas()
        ids, vectors = rows["id"].to_numpy(), np.array(rows["v"].tolist(), dtype=float)
        found = ann.op2_nearest_neighbours(spark, folder).groupBy("query_id").agg(F.collect_list("vec_id").alias("near"), F.max("rank").alias("n")).toPandas()
        near, recalls = dict(zip(found["query_id"], found["near"])), []
        for i in np.flatnonzero(ids % 100 == 0):
            far = ((vectors - vectors[i]) ** 2).sum(axis=1)
            far[i] = np.inf
            best = ids[np.lexsort((ids, far))[:10]]
            recalls.append(len(set(best.tolist()) & set(near[ids[i]])) / len(best))
        print(f"{folder}: {len(ids)} vectors, {len(recalls)} queries, recall {np.mean(recalls):.3f}, lowest {min(recalls):.1f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
