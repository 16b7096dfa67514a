"""python -m thicket.cli: simulate, tune by cross-validation, refit, sweep thresholds, and report, for one seed."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .functions import kernels as K
from .operators import folds, moments, selection
from .plans import experiments
from .ship import ship
from .sources import files, simulate


def experiment(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Simulated subjects, the chosen methods, and how well each finds groups and graphs; tables go to args.out."""
    d = args.d
    lengths = simulate.random_lengths(args.n, args.seed) if args.m == [0] else args.m[0] if len(args.m) == 1 else args.m
    obs, labels, centers = simulate.simulate(spark, args.n, lengths, d, args.proportions, args.edges, args.std, args.seed)
    obs, truth = obs.persist(), labels.join(centers, "label").persist()
    # With several criteria folds are runs of rows, as published.
    folded = folds.with_contiguous_folds(obs, args.folds) if len(args.criteria) > 1 else folds.with_shuffled_folds(obs, args.folds, args.seed)
    stats, by_fold = moments.additive(obs, d, "subject_id").persist(), moments.additive(folded, d, "subject_id", "fold").persist()
    grid = selection.param_grid(spark, {"lambda1": args.lambda1, "lambda2": args.lambda2, "tau": args.tau, "rho1": [args.rho1], "rho2": [args.rho2]})
    methods = experiments.METHODS if "all" in args.methods else tuple(args.methods)
    how = K.Settings(max_dc=args.max_dc, max_admm=args.max_admm)
    out = experiments.run(spark, stats, by_fold, truth, d, grid, args.baseline_lambda1, methods, tuple(args.criteria), how, args.two_step_tau)
    scores = [r.asDict() for r in out.scores.collect()]  # a row a method and criterion
    summary = {"seed": args.seed, "config": {k: v for k, v in vars(args).items() if k != "out"}, "scores": scores}
    if out.cv is not None:
        best = experiments.top(out.cv, tuple(args.criteria)).collect()
        summary["top5"] = {c: [r.asDict() for r in best if r["criterion"] == c] for c in args.criteria}
    if args.out:
        write(spark, args, out, summary)
    return summary


def write(spark: SparkSession, args: argparse.Namespace, out: experiments.Outcome, summary: dict) -> None:
    if out.cv is not None:
        files.write_csv(out.cv, f"{args.out}/cv_results")
        for c in args.criteria:
            files.write_summary(spark, f"{args.out}/top5_{c}", summary["top5"][c])
    for mode, table in out.tuned.items():
        files.write_csv(table, f"{args.out}/tuned_{mode}")
    files.write_csv(out.scores, f"{args.out}/scores")
    for row in summary["scores"]:
        name, mine = f"{row['method']}_{row['criterion']}", f"method = '{row['method']}' AND criterion = '{row['criterion']}'"
        files.write_csv(out.sweeps.where(mine).orderBy("threshold"), f"{args.out}/skeleton_thresholds_{name}")
        files.write_json(experiments.artifacts(out.groups.where(mine), args.d, json.loads(row["params"])), f"{args.out}/{name}_artifacts")
    files.write_summary(spark, f"{args.out}/summary", summary)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--n", type=int, default=50)
    p.add_argument("--m", type=int, nargs="+", default=[300], help="rows a subject, or one number for each; 0: random lengths")
    p.add_argument("--d", type=int, default=5)
    p.add_argument("--std", type=float, default=1.0)
    p.add_argument("--folds", type=int, default=3)
    p.add_argument("--proportions", type=float, nargs="+", default=[0.6, 0.4])
    p.add_argument("--edges", type=int, nargs="+", default=[5, 5])
    p.add_argument("--methods", nargs="+", default=["all"], choices=["all", *experiments.METHODS])
    p.add_argument("--criteria", nargs="+", default=["recon"], choices=["recon", "mle", "cov"], help="with several, one refit for each")
    p.add_argument("--lambda1", type=float, nargs="+", default=[1e-4, 1e-3, 0.01, 0.1])
    p.add_argument("--lambda2", type=float, nargs="+", default=[0.01, 1e-3, 1e-4, 1e-5])
    p.add_argument("--tau", type=float, nargs="+", default=[0.05, 0.1, 0.4, 0.7])
    p.add_argument("--rho1", type=float, default=0.1)
    p.add_argument("--rho2", type=float, default=0.05)
    p.add_argument("--baseline-lambda1", type=float, nargs="+", default=[1e-4, 1e-3, 0.01, 0.1])
    p.add_argument("--two-step-tau", type=float, default=0.7)
    p.add_argument("--max-dc", type=int, default=10)
    p.add_argument("--max-admm", type=int, default=15)
    p.add_argument("--out", default="")
    args = p.parse_args(argv)
    spark = ship(SparkSession.builder.appName("thicket").getOrCreate())
    print(json.dumps(files.plain(experiment(spark, args)), indent=2))


if __name__ == "__main__":
    main()
