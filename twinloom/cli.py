"""Command line: demo, generate, evaluate and certify."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinloom.operators.evaluate import certificate, evaluate
from twinloom.operators.generate import generate
from twinloom.sources.io import as_json, default_output, read_provenance, read_table, write_twin


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo", help="generate and evaluate a small built-in table")
    g = sub.add_parser("generate", help="write a twin and its provenance")
    g.add_argument("real")
    g.add_argument("-o", "--output")
    g.add_argument("--k", type=int, default=2, help="passes; more: stronger privacy")
    g.add_argument("--mix-prob", type=float, default=0.75, help="0 to 1; higher: more private")
    g.add_argument("--seed", type=int)
    g.add_argument("--surrogates", action="store_true", help="replace texts with many values one by one, instead of leaving them out")
    e = sub.add_parser("evaluate", help="score a twin")
    c = sub.add_parser("certify", help="write a certificate")
    for x in (e, c):
        x.add_argument("real")
        x.add_argument("twin")
        x.add_argument("--skip-privacy", action="store_true")
        x.add_argument("--n-attacks", type=int, default=500)
        x.add_argument("--n-secrets", type=int, default=5)
        x.add_argument("--n-reps", type=int, default=10)
        x.add_argument("--n-neighbors", type=int, default=1)
        x.add_argument("--n-aux-cols", type=int, default=20)
        x.add_argument("--seed", type=int)
    c.add_argument("-o", "--output", default="cert.html")
    c.add_argument("--k", type=int)
    c.add_argument("--mix-prob", type=float)
    for x in (demo, g, e, c):
        x.add_argument("--json", action="store_true", help="machine-readable output")
        if x is not demo:
            x.add_argument("--key", help="columns that make rows unique, comma-separated (default: a row number)")
    return p


def _keyed(df, key: str | None):
    """The table with one key column."""
    if key and "," not in key:
        return df, key
    if key:
        return df.withColumn("_key", F.concat_ws("|", *key.split(","))), "_key"
    from twinloom.operators.ranking import ranked

    return ranked(df, [F.col(f"`{c}`").asc_nulls_first() for c in df.columns], "_key"), "_key"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("twinloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    began = time.time()
    if a.command == "demo":
        df = spark.range(2000).select("id", (F.col("id") % 7).alias("grade"), F.sin("id").alias("x"), (F.sin("id") + F.cos(F.col("id") * 3)).alias("y"))
        found = evaluate(df, generate(df, "id", seed=1).df, "id", n_attacks=100, n_reps=2, seed=1)
        print(as_json(found))
        return 0
    df = read_table(spark, a.real)
    keyed, key = _keyed(df, a.key)
    if a.command == "generate":
        loaded = time.time() - began
        result = generate(keyed, key, a.k, a.mix_prob, a.seed, keep_key=key != "_key", surrogates=a.surrogates)
        out = a.output or default_output(a.real)
        done = write_twin(result, out, load_seconds=round(loaded, 3))
        p = done.first()
        print(as_json(done) if a.json else f"{out}: {p.n_rows} rows x {p.n_cols} columns, load {p.load_seconds:.1f} s + run {p.run_seconds:.1f} s, seed {p.seed}")
        return 0
    options = {k: getattr(a, k) for k in ("skip_privacy", "n_attacks", "n_secrets", "n_reps", "n_neighbors", "n_aux_cols", "seed")}
    twin, _ = _keyed(read_table(spark, a.twin), a.key)
    found = evaluate(keyed, twin, key, **options)
    if a.command == "evaluate":
        print(as_json(found) if a.json else json.dumps(json.loads(as_json(found)), indent=2))
        return 0
    prov = read_provenance(spark, a.twin)
    for name in ("k", "mix_prob", "seed"):
        if getattr(a, name) is not None:
            prov = prov.withColumn(name, F.lit(getattr(a, name)))
    Path(a.output).write_text(certificate(found, prov))
    print(as_json(found.crossJoin(prov.select(F.struct("*").alias("provenance")))) if a.json else a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
