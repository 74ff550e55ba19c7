from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))
from cases import documents, empty, rows  # noqa: E402
from oracle import connect, rows_of, rows_of_sql  # noqa: E402

from docloom.llm import quality_rules  # noqa: E402


def model(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    got = quality_rules.apply_rules(documents(spark)).collect()
    want = Counter((x[0], *model(x[1])) for x in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.apply_rules(empty(spark)).count() == 0


def test_sql_and_clean_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = spark.createDataFrame(quality_rules.apply_rules(d).collect())  # planned and run once
    assert rows_of(out) == rows_of_sql(connect(sf_dir), quality_rules.SQL)
    x = out.toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    assert not ((x.quality == 1) & ~x.base_failed & ~x.kept).any()
    assert ((x.quality == 0) & x.kept).sum() <= 0.1 * (x.quality == 0).sum()


def test_no_python_in_plan(spark):
    plan = quality_rules.apply_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
