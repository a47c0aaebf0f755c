"""python -m veilgram.cli sample PEOPLE ATTRS STATUS OUT | link SAMPLE bf L,RATIO blip METHOD,P"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from veilgram.config import LinkConfig, SampleConfig
from veilgram.operators import evaluate, match
from veilgram.plans.linkage import Linkage
from veilgram.plans.sampling import Sampling
from veilgram.sources import people, samples


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    s = sub.add_parser("sample")
    s.add_argument("people")
    s.add_argument("attrs", help="column indices, such as 3,4 or [3,4]")
    s.add_argument("status", type=int)
    s.add_argument("out")
    s.add_argument("--id", type=int, default=0)
    s.add_argument("--subset", type=int, default=1000)
    s.add_argument("--base", type=int, default=1_000_000)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--csv", action="store_true")
    k = sub.add_parser("link")
    for x in ("sample", "encoding", "bf_params", "hardening", "noise_params"):
        k.add_argument(x)
    k.add_argument("--seed", type=int, default=42)
    k.add_argument("--subset", type=int, default=1000)
    k.add_argument("--base", type=int, default=1_000_000)
    k.add_argument("--csv", action="store_true")
    a = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "sample":
        attrs = [int(x) for x in a.attrs.strip("[]").split(",")]
        good, bad = people.people(people.scan(spark, a.people), a.id, a.status, attrs)
        run = Sampling(good, SampleConfig(n_subset=a.subset, n_base=a.base, seed=a.seed))
        print(f"{bad.count()} rows quarantined")
        lost = people.missing(run.normalised).first()
        print(f"{lost['n_missing']} of {lost['n_active']} active rows have a missing value")
        evaluate.validate(run.sample, a.subset, a.base)
        (samples.write_csv if a.csv else samples.write)(run.sample, a.out)
    else:
        length, ratio = a.bf_params.strip("[]()").split(",")
        method, prob = a.noise_params.strip("[]()").split(",")
        cfg = LinkConfig(a.encoding, a.hardening, int(length), float(ratio), method.strip(" '\""), float(prob), a.seed)
        rows = (samples.read_csv if a.csv else samples.read)(spark, a.sample).persist()
        evaluate.validate(rows, a.subset, a.base)
        match.to_report(Linkage(rows, cfg).tally).show(truncate=False)


if __name__ == "__main__":
    main()
