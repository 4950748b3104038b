"""python -m tessera generate|convert|train|evaluate|run: the workflows around training and recorded calls."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.wordpiece import NgramEncoder
from .operators.history import infer_actions
from .operators.listnet import Controller, ListNet, evaluate, prepare_inputs, train_federated
from .operators.samples import training_samples
from .operators.training import numbered, split_sizes, train_by_epochs
from .plans.rerank import run_calls
from .sources import tables
from .sources.scratch import materialize


#: What the program ends with: all fine, and results with faults.
FINE, FAULTY = 0, 2


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    for name, needs in (("generate", ["out"]), ("convert", ["histories", "out"]), ("train", ["samples", "out"]), ("evaluate", ["samples", "net"]), ("run", ["calls", "out"])):
        c = sub.add_parser(name)
        for n in needs:
            c.add_argument(n)
        c.add_argument("--seed", type=int, default=0)
    sub.choices["generate"].add_argument("--users", type=int, default=10)
    for flag, kind, default in (("--epochs", int, 1), ("--batch-size", int, 32), ("--rate", float, 0.1), ("--evaluation-split", float, 0.2)):
        sub.choices["train"].add_argument(flag, type=kind, default=default)
    for flag, kind, default in (("--users-each-round", int, 10), ("--rounds", int, 0), ("--dump-every", int, 0)):
        sub.choices["train"].add_argument(flag, type=kind, default=default, help="rounds: federated training by the samples' users instead of epochs" if flag == "--rounds" else None)
    sub.choices["run"].add_argument("--pre-run", type=int, default=0)
    sub.choices["run"].add_argument("--return-state", action="store_true")
    sub.choices["run"].add_argument("--net")
    sub.choices["run"].add_argument("--as-of", help="the time of the calls; now if not given")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    if a.command == "generate":
        tables.synthetic_calls(spark, a.users, seed=a.seed).write.mode("overwrite").parquet(a.out)
    elif a.command == "convert":
        raw = tables.read_history_csv(spark, a.histories)
        rows = infer_actions(raw).withColumnRenamed("inferred_action", "user_action")
        tables.write_samples(training_samples(rows), a.out, append=False)
    elif a.command == "train":
        rows = materialize(numbered(prepare_inputs(tables.read_samples(spark, a.samples)), "sample_id"))
        n, n_held = split_sizes(rows.count(), a.evaluation_split)
        fit, held = rows.filter(F.col("number") < n), rows.filter(F.col("number") >= n)
        if a.rounds:
            net = train_federated(fit, "sample_id", a.rounds, a.users_each_round, a.epochs, a.rate, a.seed)
            costs = [evaluate(net, held)]
        else:
            control = Controller(dump=(lambda name, n: np.savez(f"{a.out}-{name}", **n.params)) if a.dump_every else None, every=a.dump_every or 1, tell=print)
            net, costs = train_by_epochs(fit, n, a.epochs, a.batch_size, a.rate, a.seed, evaluation=held if n_held else None, controller=control)
        np.savez(a.out, **net.params)
        print("evaluation costs by epoch:", costs)
    elif a.command == "evaluate":
        with np.load(a.net) as f:
            net = ListNet({k: f[k] for k in f.files})
        print("mean cost:", evaluate(net, prepare_inputs(tables.read_samples(spark, a.samples))))
    else:
        calls = tables.read_calls(spark, a.calls).withColumn("call", F.xxhash64("file"))
        net = None
        if a.net:
            with np.load(a.net) as f:
                net = ListNet({k: f[k] for k in f.files})
        as_of = F.lit(a.as_of).cast("timestamp") if a.as_of else F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        names = calls.select(F.col("call").alias("user_id"), "file")
        done, faults, analytics, states = run_calls(calls, NgramEncoder(), as_of, net, a.pre_run)
        named = lambda frame: None if frame is None else frame.join(names, "user_id").drop("user_id", "request_id")
        tables.write_results(named(done), named(faults), a.out, named(analytics))
        if a.return_state:
            named(states).select("file", F.base64("state").alias("serialized_state")).write.mode("overwrite").json(f"{a.out}/states")
        return FAULTY if faults.limit(1).count() else FINE
    return FINE


if __name__ == "__main__":
    sys.exit(main())
