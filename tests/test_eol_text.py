from __future__ import annotations

from pyspark.sql import functions as F

from depvital.operators import eol_text

CASES = [
    # profile, name, text, kind, successor, date
    ("message", "pkg", "This project has been discontinued and archived.", "strong", None, None),
    ("message", "pkg", "The library has reached end of life and should not be used.", "contextual", None, None),
    ("message", "pkg", "This project is not deprecated and still maintained.", None, None, None),
    ("message", "pkg", "This project is no longer maintained and replaced by newlib.", "strong", "newlib", None),
    ("message", "pkg", "This project is no longer maintained. Please use coolpkg instead", "strong", "coolpkg", None),
    ("message", "pkg", "This project is no longer maintained and moved to @scope/newpkg", "strong", "@scope/newpkg", None),
    ("message", "pkg", "The library has reached end of. life status soon", None, None, None),
    ("message", "pkg", "�This pACkAgeno longer mAintAined", "strong", None, None),
    ("message", "testpkg", "This package is sunset", "explicit", None, None),
    ("message", "pkg", "This tool is retired but still active.", None, None, None),
    ("message", "pkg", "It will be retired on 2025-06-30.", "strong", None, "2025-06-30"),
    ("message", "pkg", "Security fixes until March 3, 2025.", "contextual", None, "March 3, 2025"),
    ("registry", "foo", "Foo lib\nThis project is deprecated and no longer maintained.", "explicit", None, None),
    ("registry", "foo", "Deprecated function bar() will be removed.", None, None, None),
    ("registry", "foo", "Deprecated function bar() in this project is deprecated permanently.", None, None, None),
    ("registry", "foo",
     "Deprecated function bar() will be removed. This project is deprecated and no longer maintained.", "explicit", None, None),
    ("registry", "foo", "Deprecated function bar(). Deprecated method baz(). Final note about internal refactor.", None, None, None),
    ("registry", "alpha", "This package is deprecated: use beta instead.", "explicit", "beta", None),
    ("registry", "foo", "This package is deprecated: use foo instead.", "explicit", None, None),
    ("registry", "alpha", "Superseded by gamma", "strong", "gamma", None),
    ("registry", "alpha",
     "This package is deprecated and no longer maintained.\n\nMore details about migration.\nSome other notes.\n"
     "API changes listed below.\nUse distantpkg instead for new projects.", "explicit", None, None),
    ("registry", "zope.interface", "Python 2.3 is no longer supported.", None, None, None),
    ("registry", "pkgname", "No longer supported.", None, None, None),
    ("registry", "mypkg", "This project is no longer supported.", "explicit", None, None),
    ("registry", "pkg", "x" * 250 + "\nChangelog\n1.0 old module retired", None, None, None),
    ("registry", "pkg", "Intro\nChangelog\n1.0 old module retired", "strong", None, None),
    ("readme", "testrepo", "This repository is now sunsetted", "explicit", None, None),
    ("readme", "testrepo", "Consider this project obsolete.", "explicit", None, None),
    ("readme", "testrepo", "Sunsetting this project effective today. Renamed to newer-lib", "explicit", "newer-lib", None),
    ("readme", "testrepo", "Nothing to see here", None, None, None),
    ("readme", "testrepo", "", None, None, None),
]


def test_announcements(spark):
    for profile in ("message", "registry", "readme"):
        rows = [(i, name, text) for i, (p, name, text, *_) in enumerate(CASES) if p == profile]
        docs = spark.createDataFrame(rows, "i INT, name STRING, text STRING")
        for r in eol_text.detect_eol(docs, profile).collect():
            assert (r.eol_kind, r.eol_successor, r.eol_date) == CASES[r.i][3:], CASES[r.i]


def test_phrase_statistics(spark):
    docs = spark.createDataFrame([(1, "It was RETIRED. eol"), (2, "retired and deprecated")], "doc_id INT, text STRING")
    stats = {(r.tier, r.phrase): r.documents for r in eol_text.phrase_stats(docs).collect()}
    assert stats[("strong", "retired")] == 2 and stats[("reevaluate", "deprecated")] == 1
    assert stats[("strong", "superseded by")] == 0
    assert len(stats) == 11 + 12 + 38 + 8 + 1
    assert eol_text.phrase_hits(docs, ("strong",)).count() == 2


def test_npm_successor(spark):
    rows = [("Please use @new/pkg instead.", "@new/pkg"), ("moved to other!", "other"), ("use me", None),
            ("migrate to ESM", None), ("use (weird*name) moved to good", "good"), ("Replaced by X.", "X"), (None, None)]
    df = spark.createDataFrame([(m, w) for m, w in rows], "m STRING, want STRING")
    got = df.select("want", eol_text.npm_successor(F.col("m"), F.lit("me"), F.lit("@s/me")).alias("s")).collect()
    assert all(r.want == r.s for r in got)


def test_summaries(spark):
    rows = [("  a \n\t b  ", "a b"), ("x" * 200, "x" * 200), ("y" * 201, "y" * 199 + "…"), ("   ", None)]
    df = spark.createDataFrame(rows, "t STRING, want STRING")
    got = df.select("want", eol_text.normalize_summary(F.col("t")).alias("s")).collect()
    assert all(r.want == r.s for r in got)
    rows = [("One thing. Two", "One thing."), ("v3.0 released. Next", "v3.0 released."), ("Para one\n \nPara two.", "Para one"),
            ("no end", "no end"), ("is 3. and more! ok", "is 3. and more!")]
    df = spark.createDataFrame(rows, "t STRING, want STRING")
    got = df.select("want", eol_text.first_sentence(F.col("t")).alias("s")).collect()
    assert [(r.want) for r in got] == [r.s for r in got]


def test_sentences(spark):
    df = spark.createDataFrame([("First sentence.\nSecond line!\nThird? Fourth line",)], "t STRING")
    got = df.select(eol_text.split_sentences(F.col("t"))).first()[0]
    assert got == ["First sentence.", "Second line!", "Third?", "Fourth line"]
