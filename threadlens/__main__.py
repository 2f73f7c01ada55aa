"""Job entry (``spark-submit -m threadlens`` / ``python -m threadlens``).

  analyze     posts + comments tables -> reports (JSON and/or Markdown sinks)
  batch       URL list file + posts + comments -> per-URL success/error rows and a summary
  memo-stats  entries per memo table
  memo-purge  drop expired entries of a memo store (writes a new snapshot)
"""

from __future__ import annotations

import argparse
import sys


def _tables(spark, a):
    from pyspark.sql import functions as F

    from threadlens.plans import pipeline as PL
    posts = spark.read.parquet(a.posts)
    if "post_id" not in posts.columns:
        posts = posts.withColumn("post_id", F.col("id"))
    if "extracted_text" not in posts.columns:
        ocr = spark.read.parquet(a.ocr) if a.ocr else None
        links = spark.read.parquet(a.links) if a.links else None
        posts = PL.post_content(posts, ocr, links)
    return posts, spark.read.parquet(a.comments)


def main(argv=None) -> int:
    from threadlens.params import Params
    from threadlens.session import get_spark

    ap = argparse.ArgumentParser(prog="threadlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("analyze", "batch"):
        p = sub.add_parser(name)
        p.add_argument("--posts", required=True)
        p.add_argument("--comments", required=True)
        p.add_argument("--ocr")
        p.add_argument("--links")
        p.add_argument("--out", required=True)
        p.add_argument("--as-of", required=True, help="analysis timestamp, e.g. 2024-01-31T00:00:00")
        p.add_argument("--format", default="both", choices=["json", "markdown", "both"])
        p.add_argument("--quality-threshold", type=float, default=Params.quality_threshold)
        p.add_argument("--max-comments", type=int, default=Params.max_comments)
        p.add_argument("--memo", help="path of the memo store of reports: live entries are reused, new ones added")
        p.add_argument("--no-cache", action="store_true", help="analyse posts with live entries too")
        p.add_argument("--batch-size", type=int, default=Params.batch_size)
        if name == "batch":
            p.add_argument("--urls", required=True, help="text file(s), one URL per line, '#' comments")
    for name in ("memo-stats", "memo-purge", "memo-clear", "memo-delete"):
        p = sub.add_parser(name)
        p.add_argument("--store", required=True, action="append", help="name=path of a memo store")
        if name == "memo-delete":
            p.add_argument("--key-column", required=True)
            p.add_argument("--key", required=True, action="append")
        if name == "memo-purge":
            p.add_argument("--as-of", required=True)
            p.add_argument("--ttl-hours", type=int, default=Params.memo_ttl_hours)
    a = ap.parse_args(argv)
    spark = get_spark()

    if a.cmd in ("analyze", "batch"):
        from threadlens.plans import pipeline as PL
        from pyspark.sql import functions as F

        from threadlens.operators.memo import MemoStore
        from threadlens.schemas import MEMO_REPORT
        from threadlens.sources.reports import save_reports
        from threadlens.sources.urllist import load_url_list
        params = Params(quality_threshold=a.quality_threshold, max_comments=a.max_comments, batch_size=a.batch_size)
        posts, comments = _tables(spark, a)
        if a.cmd == "batch":
            urls = load_url_list(spark, a.urls)
            posts, comments = PL.requested(urls, posts, comments)
        if a.memo:
            store = MemoStore(spark, a.memo)
            memo = store.read(MEMO_REPORT)
            memo = memo.withColumn("post_id", F.col("post_id").cast(posts.schema["post_id"].dataType))
            reports, new = PL.analyze_reuse(posts, comments, memo, a.as_of, params, use_cache=not a.no_cache)
            store.upsert(new, "post_id")
        else:
            reports = PL.analyze(posts, comments, a.as_of, params)
        if a.cmd == "analyze":
            for path in save_reports(reports, a.out, a.format):
                print(path)
            return 0
        from threadlens.operators.stats import batch_summary
        res = PL.analyze_batch(urls, reports).checkpoint(eager=True)
        res.select("post_url", "success", "error", "report").write.mode("overwrite").json(f"{a.out}/batch")
        s = batch_summary(res).first()
        print(f"{s.succeeded}/{s.total} succeeded")
        return 0 if s.all_ok else 1

    from threadlens.operators.memo import MemoStore, memo_stats
    stores = {n: MemoStore(spark, p) for n, p in (x.split("=", 1) for x in a.store)}
    if a.cmd == "memo-stats":
        tables = {n: s.read() for n, s in stores.items() if s.read() is not None}
        for r in memo_stats(tables).collect() if tables else []:
            print(f"{r.table_name}\t{r.entries}")
        return 0
    for n, s in stores.items():
        if a.cmd == "memo-clear":
            s.clear()
        elif a.cmd == "memo-delete":
            s.delete(spark.createDataFrame([(k,) for k in a.key], f"{a.key_column} string"), a.key_column)
        else:
            c = s.purge(a.as_of, a.ttl_hours)
            print(f"{n}\t{c[0]} purged\t{c[1]} kept" if c else f"{n}\tempty")
    return 0


if __name__ == "__main__":
    sys.exit(main())
