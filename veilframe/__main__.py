"""``python -m veilframe FILE [--mode pseudonym] [--style curly]``: a file's findings, figures and whether it comes back unchanged."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .options import MODES, STYLES, Options
from .plans import engine
from .sources.io import read_documents, vault_json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilframe", description=__doc__)
    parser.add_argument("path", help="a text file, or a folder of them")
    parser.add_argument("--mode", choices=MODES, default="token")
    parser.add_argument("--style", choices=sorted(STYLES), default="bracket")
    parser.add_argument("--text", action="store_true", help="print the redacted text too")
    parser.add_argument("--vault", action="store_true", help="print the vault, which holds the originals")
    given = parser.parse_args(argv)
    options = Options(mode=given.mode, style=given.style)
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    docs = read_documents(spark, given.path)
    done = engine.redact(docs, options=options, id_col="doc_name")
    for r in engine.findings(done, "doc_name").orderBy("doc_name", "place").select("doc_name", "type", "token", "count", "risk", "confidence").toLocalIterator():
        print(*r, sep="\t")
    for r in engine.stats(done, id_col="doc_name").orderBy("doc_name").toLocalIterator():
        print(r.doc_name, f"{r.occurrences} values, {r['distinct']} distinct", f"risk {r.risk_score} {r.risk_label}", sep="\t")
    if given.text:
        for r in done.select("doc_name", "redacted").toLocalIterator():
            print(r.doc_name, r.redacted, sep="\n")
    if given.vault:
        print(vault_json([e.asDict() for r in done.select("entries").toLocalIterator() for e in r.entries], options))
    bad = engine.verify_round_trip(docs, options=options).where(~F.col("ok")).count()
    print("round trip:", "unchanged" if not bad else f"{bad} documents differ")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
