"""Whitelisted computations over spreadsheet rows.

Rows are source_path, filename, sheet, row_number and cells (a map of text). A ``Computation`` is planned from a question
before any job starts; planning either gives a plan or a question back (``clarify``). Running it is a DataFrame plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import markers as M
from docloom.functions.numbers import format_number, parse_number

RESULT_ROWS = 20
METRIC_KINDS = ("int", "float", "numeric", "number", "percentage", "currency")


@dataclass(frozen=True)
class Sheet:
    source_path: str
    sheet: str
    columns: tuple[str, ...]
    kinds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Computation:
    operator: str = "count"
    column: str | None = None
    comparison: str | None = None
    threshold: float | None = None
    group_by: str | None = None
    extreme: str | None = None
    sheet: str | None = None
    columns: tuple[str, ...] = ()
    source_paths: tuple[str, ...] = ()
    clarify: str | None = None


def _any(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def _fold(text: str) -> str:
    return re.sub(r"[\s._\-\\/：:（）()\[\]【】]+", "", text.casefold())


def operator_of(question: str) -> str:
    for name, words in (("sum", M.SUM), ("avg", M.AVG), ("max", M.MAX), ("min", M.MIN), ("count", M.COUNT_ROWS)):
        if _any(question, words):
            return name
    return "filter" if _any(question, M.FILTER) and re.search(r"\d", question) else "count"


def condition_of(question: str) -> tuple[str | None, float | None]:
    """The comparison and its threshold; a percent sign scales the threshold as it scales cells."""
    m = re.search(M.CONDITION, question)
    if not m:
        return None, None
    raw = m[2].rstrip(".,")
    try:
        value = float(raw.rstrip("%").replace(",", ""))
    except ValueError:
        return None, None
    return M.COMPARISONS[m[1]], value / 100 if raw.endswith("%") else value


def column_of(question: str, columns: tuple[str, ...]) -> str | None:
    found = [c for c in columns if c and (c in question or re.sub(r"[\s.]+", "", c.casefold()) in _fold(question))]
    return max(found, key=len, default=None)


def group_of(question: str, columns: tuple[str, ...], target: str | None) -> tuple[str | None, str | None]:
    if not _any(question, M.GROUP_MAX + M.GROUP_MIN):
        return None, None
    extreme = "max" if _any(question, M.GROUP_MAX) else "min"
    found = [c for c in columns if c and c != target and c in question]
    return max(found, key=len, default=None), extreme


def mentions(question: str, source_path: str) -> bool:
    """Whole stem, or any two neighbouring characters of it (every longer mention holds such a pair)."""
    stem = _fold(source_path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    q = _fold(question)
    return bool(stem and q) and (stem in q or any(stem[i : i + 2] in q for i in range(len(stem) - 1)))


def plan_computation(question: str, sheets: list[Sheet], source_paths: tuple[str, ...] = (), column: str | None = None) -> Computation:
    ask = lambda text, columns=(): Computation(clarify=text, columns=tuple(columns))
    question = (question or "").strip()
    if not question:
        return ask("问题为空，请说明要对哪个表格做什么计算。")
    paths = sorted({s.source_path for s in sheets})
    if not paths:
        return ask("没有找到可计算的 Excel/CSV 表格文档。")
    wanted = [p for p in source_paths if p in paths] or [p for p in paths if mentions(question, p)] or paths
    mine = [s for s in sheets if s.source_path in wanted]
    sheet = next((s.sheet for s in sorted(mine, key=lambda s: -len(s.sheet)) if s.sheet and s.sheet.casefold() in question.casefold()), None)
    if sheet is None:
        names: dict[str, set[str]] = {}
        for s in mine:
            names.setdefault(s.source_path, set()).add(s.sheet)
        if several := [p for p in sorted(names) if len(names[p]) > 1]:
            return ask(f"检测到文件内多个 Sheet（{'、'.join(x for p in several for x in sorted(names[p]))}），请指定要对哪个 Sheet 计算。")
        sheet = next((s.sheet for s in mine if s.sheet), None)
    cross = _any(question, M.CROSS_FILE)
    owners = sorted({s.source_path for s in mine if s.sheet == sheet})
    if sheet and not cross and len(owners) > 1:
        return ask(f"多个文件都有 Sheet「{sheet}」（{'、'.join(p.rsplit('/', 1)[-1] for p in owners)}），请指定要对哪个文件计算。")
    own = next((s for s in mine if s.sheet == sheet), mine[0])
    op = operator_of(question)
    target = column if column in own.columns else column_of(question, own.columns)
    if op in ("sum", "avg", "max", "min") and not target:
        numeric = [c for c, k in zip(own.columns, own.kinds, strict=False) if k in METRIC_KINDS]
        if not numeric:
            return ask(f"没有找到数值列，无法求和/平均/最大/最小。可用列：{'、'.join(own.columns)}")
        if len(numeric) > 1:
            return ask(f"有多个数值列，请指定对哪一列计算。可用列：{'、'.join(numeric)}", numeric)
        target = numeric[0]
    comparison, threshold = condition_of(question)
    if op == "filter" and (not target or not comparison):
        return ask(f"筛选条件不明确，请说明按哪一列、什么条件筛选。可用列：{'、'.join(own.columns)}", own.columns)
    if comparison and not target:
        return ask(f"筛选条件不明确，请说明按哪一列筛选。可用列：{'、'.join(own.columns)}", own.columns)
    group, extreme = group_of(question, own.columns, target)
    return Computation(op, target, comparison, threshold, group, extreme if group else None, sheet, own.columns, tuple(owners or wanted))


def cell(column: str) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(column)), F.lit(""))


def scoped(rows: DataFrame, c: Computation) -> DataFrame:
    """Rows of the plan's files and sheet, each once, that meet the condition; rows without a number there do not."""
    out = rows.where(F.col("source_path").isin(*c.source_paths)) if c.source_paths else rows
    if c.sheet:
        out = out.where(F.col("sheet") == c.sheet)
    out = out.dropDuplicates(["source_path", "sheet", "row_number"])
    if c.comparison:
        v, t = parse_number(cell(c.column)), F.lit(c.threshold)
        out = out.where({"gt": v > t, "ge": v >= t, "lt": v < t, "le": v <= t}[c.comparison])
    return out


def compute(rows: DataFrame, c: Computation) -> DataFrame:
    """One row: operator, value, n_rows, answer; for a group's extreme also its name and evidence row."""
    if c.clarify:
        raise ValueError(c.clarify)
    x = scoped(rows, c)
    label = f"{c.sheet or '表格'}中“{c.column}”" if c.column else (c.sheet or "表格")
    if c.operator == "filter":
        return matches(x, c)
    if c.operator == "count":
        return x.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("count").alias("operator"), F.col("n_rows").cast("double").alias("value"), "n_rows", F.concat(F.lit("共 "), F.col("n_rows").cast("string"), F.lit(" 行")).alias("answer"))
    x = x.withColumn("v", parse_number(cell(c.column)))
    if c.group_by and c.extreme:
        return group_extreme(x, c)
    agg = {"sum": F.sum("v"), "avg": F.avg("v"), "max": F.max("v"), "min": F.min("v")}[c.operator]
    word = {"sum": "合计", "avg": "平均值", "max": "最大值", "min": "最小值"}[c.operator]
    out = x.where("v IS NOT NULL").agg(agg.alias("value"), F.count(F.lit(1)).alias("n_rows"))
    answer = F.when(F.col("n_rows") > 0, F.concat(F.lit(f"{label}{word} = "), format_number(F.col("value")))).otherwise(F.lit(f"列“{c.column}”没有数值，无法计算。"))
    return out.select(F.lit(c.operator).alias("operator"), "value", "n_rows", answer.alias("answer"))


def group_extreme(x: DataFrame, c: Computation) -> DataFrame:
    """The group with the extreme value, and the row that has it; ties go to the earliest row."""
    key = F.coalesce(F.nullif(cell(c.group_by), F.lit("")), F.lit("?"))
    sign = -1.0 if c.extreme == "max" else 1.0
    place = F.struct((sign * F.col("v")).alias("s"), "source_path", "sheet", "row_number")
    g = x.where("v IS NOT NULL").groupBy(key.alias("group")).agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n_rows"))
    best = g.orderBy("p").limit(1)
    value = sign * F.col("p.s")
    answer = F.concat(F.lit(f"{c.group_by}中“{c.column}”{c.extreme}的是 "), F.col("group"), F.lit("（"), format_number(value), F.lit("）"))
    return best.select(F.lit(f"arg{c.extreme}").alias("operator"), value.alias("value"), "n_rows", "group", F.col("p.source_path").alias("source_path"), F.col("p.row_number").alias("row_number"), answer.alias("answer"))


def matches(x: DataFrame, c: Computation, name: str | None = None) -> DataFrame:
    """Rows that meet the condition, with the text the answer lists."""
    shown = F.coalesce(F.nullif(cell(name or c.group_by or (c.columns[0] if c.columns else "")), F.lit("")), F.concat(F.lit("第"), F.col("row_number").cast("string"), F.lit("行")))
    return x.select("source_path", "sheet", "row_number", F.concat(shown, F.lit("（"), cell(c.column), F.lit("）")).alias("item"))


def listing(matched: DataFrame, cap: int = RESULT_ROWS) -> DataFrame:
    """One row: how many rows matched, and the first ``cap`` of them in one text."""
    first = matched.orderBy("source_path", "sheet", "row_number").limit(cap)
    shown = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_path", "sheet", "row_number", "item"))), lambda r: r["item"]), "、").alias("items"))
    return matched.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(shown)  # one row each


def across_files(c: Computation, paths: tuple[str, ...]) -> Computation:
    return replace(c, source_paths=paths)


def row_evidence(rows: DataFrame, cap: int = RESULT_ROWS) -> DataFrame:
    """Computed rows as citable sources."""
    text = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("："), e["value"])), "；")
    return rows.orderBy("source_path", "sheet", "row_number").limit(cap).select("source_path", "sheet", "row_number", text.alias("content"))
