"""Command line: train a detector, or score a folder of message files.

  python -m mailsieve.predict train --sf-dir /root/testdata/sf0.01 --out DIR
  python -m mailsieve.predict score --folder MAILDIR --models DIR --mode ENSEMBLE --out OUT [--show 5]

`score` reads every message below MAILDIR with the binaryFile source, parses
them with the MIME job, scores them and writes Parquet to OUT; `--show`
prints the first rows by mail id.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="mailsieve.predict")
    sub = ap.add_subparsers(dest="cmd", required=True)
    tr = sub.add_parser("train")
    tr.add_argument("--sf-dir", required=True)
    tr.add_argument("--out", required=True)
    sc = sub.add_parser("score")
    sc.add_argument("--folder", required=True)
    sc.add_argument("--models", required=True)
    sc.add_argument("--mode", default="ENSEMBLE")
    sc.add_argument("--out", required=True)
    sc.add_argument("--show", type=int, default=0)
    args = ap.parse_args(argv)

    from .operators import detection as D
    from .session import build_session, many_small_files, materialize
    from .sources import mail as SM
    spark = build_session()
    if args.cmd == "train":
        from .plans.catalog import mail_email
        corpus = mail_email(spark, args.sf_dir).select("mail_id", "subject", "body", "urls", "label", "quality")
        D.train_detector(corpus).save(args.out)
        print(f"saved detector to {args.out}")
        return
    files = SM.scan_mail_files(spark, args.folder)
    with many_small_files(spark):
        parsed = materialize(SM.parse_messages(files), "parsed")  # read several times below
    mails = parsed.filter(F.col("error").isNull()).select(F.col("path").alias("mail_id"), "subject", "raw_body")
    out = D.score_mails(mails, D.Detector.load(spark, args.models), args.mode).withColumnRenamed("mail_id", "path")
    failed = parsed.filter(F.col("error").isNotNull()).select("path", "error")
    out = out.unionByName(failed, allowMissingColumns=True)  # a message that cannot be read has a row too
    out.write.mode("overwrite").parquet(args.out)
    res = spark.read.parquet(args.out)
    print(res.groupBy("level").count().orderBy("level").collect())
    if args.show:
        for r in res.orderBy("path").select("path", "prob_text", "verdict", "level").take(args.show):
            print(r.path, r.prob_text, r.verdict, r.level)


if __name__ == "__main__":
    main()
