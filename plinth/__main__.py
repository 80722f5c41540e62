"""Command line: python -m plinth generate | train | compare | run."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plinth", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("generate", help="write a synthetic table as Parquet")
    p.add_argument("kind")
    p.add_argument("path")
    p.add_argument("--rows", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42)
    p = commands.add_parser("train", help="fit a model on a CSV file with a target column and print its score")
    p.add_argument("path")
    p.add_argument("--target", default="target")
    p.add_argument("--algorithm", default="random_forest")
    p.add_argument("--task", choices=["classification", "regression"], default=None)
    p.add_argument("--test-size", type=float, default=0.2)
    p.add_argument("--output")
    p = commands.add_parser("compare", help="print the runs of an experiment folder, the best first")
    p.add_argument("folder")
    p.add_argument("--metric", required=True)
    p = commands.add_parser("run", help="run a catalogue query on a folder of tables")
    p.add_argument("name")
    p.add_argument("folder")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("plinth").getOrCreate()
    if a.command == "generate":
        from plinth.operators.generators import suite

        tables = suite(spark, a.rows, a.seed)
        if a.kind not in tables:
            parser.error(f"unknown kind; known: {sorted(tables)}")
        tables[a.kind].write.mode("overwrite").parquet(a.path)
    elif a.command == "train":
        from pyspark.sql import functions as F

        from plinth.operators import learning
        from plinth.operators.quality import task_type
        from plinth.operators.splits import hash_split
        from plinth.sources.tables import read_csv

        df = read_csv(spark, a.path)
        task = a.task or task_type(df, a.target)
        features = [c for c, k in df.dtypes if c != a.target and k in ("int", "bigint", "double", "float")]
        train, test = hash_split(df, df.columns, a.test_size)
        rows = lambda x: learning.assemble(x, features, a.target)
        model = learning.estimator(a.algorithm, task).fit(rows(train))
        score = learning.evaluator(task).evaluate(model.transform(rows(test).where(F.col("label").isNotNull())))
        if a.output:
            learning.save(model, a.output, algorithm=a.algorithm, task=task, score=score)
        print(json.dumps({"task": task, "algorithm": a.algorithm, "score": score}))
    elif a.command == "compare":
        from pyspark.sql import functions as F

        from plinth.sources.tables import read_experiments

        read_experiments(spark, a.folder).orderBy(F.desc_nulls_last(f"metric_{a.metric}")).show(50, truncate=False)
    else:
        from plinth.plans import catalog

        catalog.load()
        catalog.QUERIES[a.name](spark, a.folder).show(50, truncate=False)


if __name__ == "__main__":
    main()
