"""Commands: `process` recordings to series, summaries and daily tables; `collate` summaries to one table; `panels` of series for figures."""

from __future__ import annotations

import argparse

from kinelake import session
from kinelake.operators import bundle, circadian, network, score, sequence, summary  # noqa: F401 - network registers its scorer
from kinelake.plans import recording
from kinelake.sources import readers, writers

VERSION = "0.3.0"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="kinelake")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process", help="recordings (a path or glob of CSV, Parquet, .cwa, .bin or .gt3x) to outputs")
    p.add_argument("path")
    p.add_argument("-o", "--outdir", default="outputs")
    p.add_argument("--scheme", choices=sorted(score.SCHEMES), default="four")
    p.add_argument("--scorer", choices=sorted(score.SCORERS), help="default: forest with --model, else threshold")
    p.add_argument("--model", help="a saved model of the scorer, or a bundle (its scheme, epochs and smoother hold); default: intensity thresholds")
    p.add_argument("--bundle", action="store_true", help="--model is a bundle")
    p.add_argument("--smoother", help="a smoother's JSON file")
    p.add_argument("--no-hmm", action="store_true")
    p.add_argument("--require-sleep-above")
    p.add_argument("--single-sleep-block", action="store_true")
    p.add_argument("-r", "--sample-rate", type=int)
    p.add_argument("-e", "--exclude-first-last", choices=["first", "last", "both"])
    p.add_argument("-w", "--exclude-wear-below")
    p.add_argument("--csv-start-row", type=int, default=1)
    p.add_argument("--csv-txyz", default="time,x,y,z")
    p.add_argument("--csv-txyz-idxs")
    p.add_argument("--csv-date-format", default="%Y-%m-%d %H:%M:%S.%f")
    p.add_argument("--calibration-stdtol-min", type=float, default=0.0)
    p.add_argument("--no-calibration", action="store_true")
    p.add_argument("--no-nonwear", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    c = sub.add_parser("collate", help="summaries below a folder to one CSV table")
    c.add_argument("folder")
    c.add_argument("-o", "--out", default="collated")
    d = sub.add_parser("panels", help="written series to one row a day, for figures")
    d.add_argument("folder", help="the series folder of process")
    d.add_argument("-o", "--out", default="panels")
    d.add_argument("--scheme", choices=sorted(score.SCHEMES), default="four")
    d.add_argument("--days", type=int, help="each subject's first days only")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = session.build()
    if args.command == "collate":
        writers.collate(readers.read_summaries(spark, args.folder), args.out)
        return
    classes = score.SCHEMES[args.scheme]
    if args.command == "panels":
        rows = readers.read_series(spark, args.folder, classes)
        summary.day_panels(circadian.first_days(rows, args.days) if args.days else rows, ["acc", *classes]).write.parquet(args.out)
        return
    kind = readers.kind_of(args.path)
    held = bundle.load(spark, args.model) if args.bundle else None
    classes, epoch_s = (held.labels, held.epoch_s) if held else (classes, 30.0)
    scorer = held.scorer() if held else score.load(args.scorer or ("forest" if args.model else "threshold"), args.scheme, args.model)
    options = {"columns": args.csv_txyz, "indices": args.csv_txyz_idxs, "start_row": args.csv_start_row, "date_format": args.csv_date_format} if kind == "csv" else {}
    samples = readers.read_recording(spark, args.path, **options)
    smoother = held.smoother if held and not args.no_hmm else None
    if args.smoother and not args.no_hmm:
        smoother = sequence.HiddenMarkov.from_json("\n".join(r["value"] for r in spark.read.text(args.smoother).collect()))  # one small model
    made = recording.process(
        samples, scorer, classes, args.sample_rate, epoch_s, smoother=smoother, first_last=args.exclude_first_last, wear_below=args.exclude_wear_below, least_sleep=args.require_sleep_above, single_block=args.single_sleep_block,
        calibrate=not args.no_calibration, still_sd_least=args.calibration_stdtol_min, nonwear=not args.no_nonwear, device=f".{kind}", sizes=readers.file_sizes(spark, args.path), options=vars(args) | {"version": VERSION},
    )
    writers.write_series(made["series"], f"{args.outdir}/series", classes)
    writers.write_summaries(made["summary"], f"{args.outdir}/summary")
    writers.write_daily(made["daily"], f"{args.outdir}/daily")
    if not args.quiet:
        made["summary"].show(truncate=100)


if __name__ == "__main__":
    main()
