"""From grids of raw cells to field values (C family). Rows carry record, row_idx and cells (array of text)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Aliases of fields by sheet, in order.
ALIASES = {
    "kpi": {
        "营业收入": "total_operating_revenue", "营业收入（元）": "total_operating_revenue", "每股收益": "eps", "基本每股收益": "eps", "基本每股收益(元/股)": "eps", "基本每股收益（元/股）": "eps",
        "基本每股收益（元／股）": "eps", "稀释每股收益": "eps", "稀释每股收益(元/股)": "eps", "稀释每股收益（元/股）": "eps", "稀释每股收益（元／股）": "eps", "用最新股本计算的全面摊薄每股收益(元/股)": "eps",
        "营业总收入": "total_operating_revenue", "营业收入合计": "total_operating_revenue", "营业收入同比增长": "operating_revenue_yoy_growth", "营业总收入同比增长": "operating_revenue_yoy_growth",
        "营业收入比上年同期增长": "operating_revenue_yoy_growth", "营业总收入比上年同期增长": "operating_revenue_yoy_growth", "营业收入较上年同期增长": "operating_revenue_yoy_growth",
        "营业总收入较上年同期增长": "operating_revenue_yoy_growth", "营业收入比上年同期增减": "operating_revenue_yoy_growth", "营业总收入环比增长": "operating_revenue_qoq_growth", "营业收入环比增长": "operating_revenue_qoq_growth",
        "归属于母公司所有者的净利润": "net_profit_10k_yuan", "归属于母公司股东的净利润": "net_profit_10k_yuan", "归属于上市公司股东的净利润": "net_profit_10k_yuan", "归属于上市公司股东的净利润（元）": "net_profit_10k_yuan",
        "归属于母公司所有者的净利润（元）": "net_profit_10k_yuan", "归属于母公司股东的净利润（元）": "net_profit_10k_yuan", "归属于母公司净利润": "net_profit_10k_yuan",
        "归属于母公司所有者的净利润同比增长": "net_profit_yoy_growth", "归属于母公司股东的净利润同比增长": "net_profit_yoy_growth", "归属于上市公司股东的净利润同比增长": "net_profit_yoy_growth",
        "归属于上市公司股东的净利润比上年同期增长": "net_profit_yoy_growth", "归属于母公司所有者的净利润比上年同期增长": "net_profit_yoy_growth", "归属于母公司股东的净利润比上年同期增长": "net_profit_yoy_growth",
        "归属于母公司所有者的净利润环比增长": "net_profit_qoq_growth", "归属于母公司股东的净利润环比增长": "net_profit_qoq_growth", "归属于上市公司股东的净利润环比增长": "net_profit_qoq_growth",
        "每股净资产": "net_asset_per_share", "归属于上市公司股东的每股净资产": "net_asset_per_share", "净资产收益率": "roe", "加权平均净资产收益率": "roe", "加权平均净资产收益率（%）": "roe", "加权平均净资产收益率(%)": "roe",
        "净资产收益率（%）": "roe", "净资产收益率(%)": "roe", "均净资产收益率（%）": "roe", "均净资产收益率(%)": "roe", "经营活动产生的现金流量净额/每股": "operating_cf_per_share", "每股经营现金流": "operating_cf_per_share",
        "每股经营活动产生的现金流量净额": "operating_cf_per_share", "每股经营活动现金流量净额": "operating_cf_per_share", "扣除非经常性损益后的净利润": "net_profit_excl_non_recurring", "扣除非经常性损益后的净利润（元）": "net_profit_excl_non_recurring",
        "归属于上市公司股东的扣除非经常性损益的净利润": "net_profit_excl_non_recurring", "归属于上市公司股东的扣除非经常性损益后的净利润": "net_profit_excl_non_recurring",
        "归属于上市公司股东的扣除非经常性损益的净利润（元）": "net_profit_excl_non_recurring", "归属于本公司股东的扣除非经常性损益的净利润": "net_profit_excl_non_recurring",
        "归属于母公司所有者的扣除非经常性损益的净利润": "net_profit_excl_non_recurring", "归属于母公司股东的扣除非经常性损益的净利润": "net_profit_excl_non_recurring",
        "归属于本公司股东的每股股东权益": "net_asset_per_share", "归属于本公司股东的每股净资产": "net_asset_per_share", "扣除非经常性损益后的净利润同比增长": "net_profit_excl_non_recurring_yoy",
        "归属于上市公司股东的扣除非经常性损益的净利润同比增长": "net_profit_excl_non_recurring_yoy", "归属于母公司所有者的扣除非经常性损益的净利润同比增长": "net_profit_excl_non_recurring_yoy",
        "毛利率": "gross_profit_margin", "净利率": "net_profit_margin", "扣非加权平均净资产收益率": "roe_weighted_excl_non_recurring", "扣除非经常性损益后的加权平均净资产收益率": "roe_weighted_excl_non_recurring",
        "扣除非经常性损益后的加权平均净资产收益率（%）": "roe_weighted_excl_non_recurring", "扣除非经常性损益后的加权平均净资产收益率(%)": "roe_weighted_excl_non_recurring",
    },
    "balance": {
        "货币资金": "asset_cash_and_cash_equivalents", "现金及存放中央银行款项": "asset_cash_and_cash_equivalents", "现金及银行存款": "asset_cash_and_cash_equivalents", "应收账款": "asset_accounts_receivable", "存货": "asset_inventory",
        "交易性金融资产": "asset_trading_financial_assets", "在建工程": "asset_construction_in_progress", "资产总计": "asset_total_assets", "负债和所有者权益总计": "asset_total_assets", "负债和所有者权益(或股东权益)总计": "asset_total_assets",
        "总资产同比增长": "asset_total_assets_yoy_growth", "应付账款": "liability_accounts_payable", "预收款项": "liability_advance_from_customers", "预收账款": "liability_advance_from_customers", "负债合计": "liability_total_liabilities",
        "总负债同比增长": "liability_total_liabilities_yoy_growth", "合同负债": "liability_contract_liabilities", "合同负债及预收款项": "liability_contract_liabilities", "合同负债及预收账款": "liability_contract_liabilities",
        "短期借款": "liability_short_term_loans", "短期银行借款": "liability_short_term_loans", "资产负债率": "asset_liability_ratio", "未分配利润": "equity_unappropriated_profit", "归属于母公司股东的未分配利润": "equity_unappropriated_profit",
        "所有者权益合计": "equity_total_equity", "股东权益合计": "equity_total_equity", "归属于母公司股东权益合计": "equity_total_equity", "归属于母公司所有者权益合计": "equity_total_equity", "归属于母公司所有者的权益合计": "equity_total_equity",
        "归属于母公司所有者权益(或股东权益)合计": "equity_total_equity", "归属于上市公司股东的所有者权益": "equity_total_equity", "归属于上市公司股东的所有者权益合计": "equity_total_equity", "所有者权益(或股东权益)合计": "equity_total_equity",
    },
    "cash": {
        "现金及现金等价物净增加额": "net_cash_flow", "五、现金及现金等价物净增加额": "net_cash_flow", "现金及现金等价物净增加额同比增长": "net_cash_flow_yoy_growth", "经营活动产生的现金流量净额": "operating_cf_net_amount",
        "经营活动产生的现金流量净额（元）": "operating_cf_net_amount", "经营现金流量净额": "operating_cf_net_amount", "经营活动现金流占比": "operating_cf_ratio_of_net_cf", "销售商品、提供劳务收到的现金": "operating_cf_cash_from_sales",
        "投资活动产生的现金流量净额": "investing_cf_net_amount", "投资现金流量净额": "investing_cf_net_amount", "投资活动现金流占比": "investing_cf_ratio_of_net_cf",
        "购建固定资产、无形资产和其他长期资产支付的现金": "investing_cf_cash_for_investments", "购建固定资产、无形资产和其他长期资产所支付的现金": "investing_cf_cash_for_investments", "投资支付的现金": "investing_cf_cash_for_investments",
        "收回投资收到的现金": "investing_cf_cash_from_investment_recovery", "收回投资所收到的现金": "investing_cf_cash_from_investment_recovery", "取得借款收到的现金": "financing_cf_cash_from_borrowing", "借款收到的现金": "financing_cf_cash_from_borrowing",
        "偿还债务支付的现金": "financing_cf_cash_for_debt_repayment", "偿还借款支付的现金": "financing_cf_cash_for_debt_repayment", "筹资活动产生的现金流量净额": "financing_cf_net_amount", "筹资现金流量净额": "financing_cf_net_amount",
        "筹资活动现金流占比": "financing_cf_ratio_of_net_cf",
    },
    "income": {
        "归属于母公司所有者的净利润": "net_profit", "归属于母公司股东的净利润": "net_profit", "归属于上市公司股东的净利润": "net_profit", "净利润": "net_profit", "归属于母公司所有者的净利润同比增长": "net_profit_yoy_growth",
        "归属于母公司股东的净利润同比增长": "net_profit_yoy_growth", "归属于上市公司股东的净利润同比增长": "net_profit_yoy_growth", "净利润同比增长": "net_profit_yoy_growth", "其他收益": "other_income",
        "营业总收入": "total_operating_revenue", "营业收入": "total_operating_revenue", "营业收入同比增长": "operating_revenue_yoy_growth", "营业总收入同比增长": "operating_revenue_yoy_growth",
        "营业成本": "operating_expense_cost_of_sales", "销售费用": "operating_expense_selling_expenses", "管理费用": "operating_expense_administrative_expenses", "财务费用": "operating_expense_financial_expenses",
        "研发费用": "operating_expense_rnd_expenses", "研发投入": "operating_expense_rnd_expenses", "研发支出": "operating_expense_rnd_expenses", "税金及附加": "operating_expense_taxes_and_surcharges",
        "营业总成本": "total_operating_expenses", "营业利润": "operating_profit", "利润总额": "total_profit", "资产减值损失": "asset_impairment_loss", "信用减值损失": "credit_impairment_loss",
    },
}
#: Fields whose blank rows mean 0; words of labels about the parent company, of total equity and of parts of a profit; figures a share; a number.
ZERO_FIELDS = (
    "asset_trading_financial_assets", "asset_construction_in_progress", "liability_short_term_loans", "liability_advance_from_customers", "liability_contract_liabilities", "financing_cf_cash_from_borrowing",
    "financing_cf_cash_for_debt_repayment", "investing_cf_cash_from_investment_recovery", "investing_cf_cash_for_investments",
)
PARENT = ("归属于母公司", "归属于上市公司", "归属于本公司")
TOTAL_EQUITY, MINORITY = ("所有者权益合计", "股东权益合计", "所有者权益(或股东权益)合计"), "少数股东权益"
PARTS_OF_PROFIT = ("持续经营", "终止经营", "少数股东损益")
A_SHARE = ("eps", "net_asset_per_share", "operating_cf_per_share")
NUMBER = r"^[-+(（]?[0-9][0-9,]*(\.[0-9]+)?[)）]?[%％]?$"


def aliases_of(sheet: str) -> list[tuple[str, str]]:
    """Aliases of a sheet and their fields, written as labels are after cleaning, each once."""
    return list(dict.fromkeys((a.translate(str.maketrans("（）：", "():")), f) for a, f in ALIASES.get(sheet, {}).items()))


def filled_rows(grid: DataFrame) -> DataFrame:
    """C-1: without rows of nulls."""
    return grid.where(F.exists("cells", lambda c: c.isNotNull() & (F.trim(c) != "")))


def labelled(grid: DataFrame) -> DataFrame:
    """C-2: label (the cells that are no numbers) and number texts of each row."""
    full = F.filter("cells", lambda c: c.isNotNull() & (F.trim(c) != ""))
    return grid.select("record", "sheet", "row_idx", T.clean_label(F.array_join(F.filter(full, lambda c: ~F.trim(c).rlike(NUMBER)), "")).alias("label"), F.filter(F.transform(full, lambda c: F.trim(c)), lambda c: c.rlike(NUMBER)).alias("numbers"))


def latched(rows: DataFrame) -> DataFrame:
    """C-8: rows after the marker of a breakdown by quarters are left out."""
    w = Window.partitionBy("record", "sheet").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("stop", F.max(T.is_noise_label(F.col("label")).cast("int")).over(w)).where("stop = 0").drop("stop")


def stitched(rows: DataFrame) -> DataFrame:
    """C-3, C-9: labels of rows without numbers go before that of the next row with numbers; blank rows of zero fields stay by themselves.

    Windows in the order that `latched` left the rows in, so they are neither sorted by anything else nor gathered in buffers that spill."""
    blank = dict.fromkeys(re.escape(a) for sheet in ALIASES for a, f in aliases_of(sheet) if f in ZERO_FIELDS)
    zero = T.without_prefix(F.col("label")).rlike(f"^(?:{'|'.join(blank)})")
    ends = ((F.size("numbers") > 0) | zero).cast("int")
    before = F.sum(ends).over(Window.partitionBy("record", "sheet").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1))
    island = Window.partitionBy("record", "sheet", "island").orderBy("row_idx")
    labels = F.collect_list("label").over(island.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = rows.withColumn("island", F.coalesce(before, F.lit(0))).withColumns({"labels": labels, "last": F.lead(F.lit(1)).over(island).isNull()})
    return parts.where("last").select("record", "sheet", "row_idx", F.array_join("labels", "").alias("label"), "numbers")


def mapped(rows: DataFrame) -> DataFrame:
    """C-4: a row for each alias of its sheet that the label holds, with the label without its numbering and the first number. The dictionary is an array in the plan, so nothing is joined."""
    def found(sheet: str, pairs: list) -> Column:
        every = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("alias"), F.lit(f).alias("field")) for i, (a, f) in enumerate(pairs)])
        return F.when(F.col("sheet") == sheet, F.filter(every, lambda x: F.col("label").contains(x["alias"])))
    rows = rows.withColumns({"bare": T.without_prefix(F.col("label")), "first": T.nth_number(F.col("numbers"), 0)})  # once a row, not once an alias
    return rows.withColumn("hit", F.explode(F.coalesce(*[found(s, aliases_of(s)) for s in ALIASES]))).select("record", "sheet", "row_idx", "label", "numbers", "bare", "first", "hit.*")


def special_score(field: Column, alias: Column, label: Column, bare: Column | None = None) -> Column:
    """C-5: what speaks for or against single fields: 60 for the parent's net profit, -35 a part of it; 70 for total equity, -70 for the parent's, -120 for
    minorities; -65 for figures a share whose alias comes late in the label; -20 for diluted earnings."""
    bare = T.without_prefix(label) if bare is None else bare
    has = lambda x, words: reduce(lambda a, b: a | b, [x.contains(w) for w in words])
    points = lambda c, n: F.when(c, n).otherwise(0)
    parent = has(label, PARENT)
    profit = points(parent, 60) - sum(points(label.contains(w), 35) for w in PARTS_OF_PROFIT)
    equity = points(has(bare, TOTAL_EQUITY), 70) - points(parent, 70) - points(label.contains(MINORITY), 120)
    late = points(field.isin(*A_SHARE) & (alias != "每股收益") & ~F.contains(F.left(bare, F.length(alias) + 2), alias), 65)
    diluted = points((field == "eps") & label.contains("稀释") & ~label.contains("基本"), 20)
    return F.when(field == "net_profit", profit).when(field == "equity_total_equity", equity).otherwise(0) - late - diluted


def scored(rows: DataFrame) -> DataFrame:
    """C-5, C-7: candidates with value and score; blank rows of zero fields have 0."""
    bare = F.col("bare")
    match = F.when(bare == F.col("alias"), 100).when(F.startswith(bare, F.col("alias")), 80).when(F.contains(bare, F.col("alias")), 55).otherwise(20)
    value = F.coalesce("first", F.when(F.col("field").isin(*ZERO_FIELDS) & F.startswith(bare, F.col("alias")), F.lit(0.0)))
    bonus = F.least(F.length("alias"), F.lit(20)) + F.least(F.size("numbers"), F.lit(3)) * 6 + F.least(F.log10(F.abs("value") + 1), F.lit(12.0))
    special = special_score(F.col("field"), F.col("alias"), F.col("label"), bare) - F.when(T.is_note_marker(F.col("numbers")), 90).otherwise(0)
    return rows.withColumn("value", value).where("value is not null").withColumn("score", F.round(match + bonus + special, 6))


def best(candidates: DataFrame) -> DataFrame:
    """C-6: the best candidate of each field; the earlier row, then alias, wins ties."""
    order = F.struct((-F.col("score")).alias("s"), "row_idx", "ord")
    return candidates.groupBy("record", "sheet", "field").agg(F.min_by(F.struct("value", "score", "row_idx"), order).alias("x")).select("record", "sheet", "field", "x.*")


def assembled(found: DataFrame, fields: list[str]) -> DataFrame:
    """C-12: a row a record and sheet, with a warning if none of the fields was mapped. There is no serial number: record is the key."""
    wide = found.groupBy("record", "sheet").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return wide.withColumn("warning", F.when(F.coalesce(*fields).isNull(), "no_mapped_fields_found"))


def fields_of(grid: DataFrame) -> DataFrame:
    """C-1 to C-9: record, sheet, field, value, score, row_idx."""
    return best(scored(mapped(stitched(latched(labelled(filled_rows(grid)))))))


def candidate_pages(pages: DataFrame, words: list[str], least: int = 2) -> DataFrame:
    """C-13: pages with enough aliases or 80 digits."""
    hits = sum((F.col("text").contains(w).cast("int") for w in words), F.lit(0))
    digits = F.regexp_count(F.col("text"), F.lit("[0-9]"))
    return pages.withColumns({"hits": hits, "digits": digits}).where((F.col("hits") >= least) | (F.col("digits") >= 80))


def grid_quality(rows: DataFrame) -> DataFrame:
    """C-17: 1.5 min(hits, 8) + min(6 density, 4) + min(rows / 8, 4) over the first 120 rows of a grid."""
    first = rows.where("row_idx < 120")
    cells, numbers = F.sum(F.size("cells")), F.sum(F.size(F.filter("cells", lambda c: c.rlike(NUMBER))))
    x = first.groupBy("grid", "sheet", "page").agg(F.countDistinct("alias").alias("hits"), F.try_divide(numbers, cells).alias("density"), F.count("*").alias("n"))
    return x.withColumn("quality", F.round(F.least(F.col("hits"), F.lit(8)) * 1.5 + F.least(F.coalesce("density", F.lit(0.0)) * 6, F.lit(4.0)) + F.least(F.col("n") / 8, F.lit(4.0)), 6))


def kept_grids(grids: DataFrame, bound: float = 5.0) -> DataFrame:
    """C-18: the two best grids of a sheet and page from the bound on, else the best if it is within 1 of it (2 at least)."""
    w = Window.partitionBy("sheet", "page")
    place, top = F.row_number().over(w.orderBy(F.desc("quality"), "grid")), F.max("quality").over(w)
    x = grids.withColumn("place", place).withColumn("top", top)
    return x.where(((F.col("place") <= 2) & (F.col("quality") >= bound)) | ((F.col("top") < bound) & (F.col("place") == 1) & (F.col("quality") >= max(2.0, bound - 1)))).drop("place", "top")


def first_method(grids: DataFrame) -> DataFrame:
    """C-20: on each page and sheet only grids of the first method that has any."""
    return grids.withColumn("first", F.min("method_order").over(Window.partitionBy("sheet", "page"))).where("method_order = first").drop("first")


def page_lines(pages: DataFrame, least: int = 4) -> DataFrame:
    """C-21: lines of a page as rows of cells: the label, then its numbers."""
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_idx", "line")).where(F.length(F.trim("line")) >= least)
    parts = T.split_numbers(F.col("line"))
    return lines.select("doc_id", "row_idx", F.concat(F.array(parts["label"]), parts["numbers"]).alias("cells"))


#: Figures whose growth over the column beside them fills a growth field, by sheet.
GROWTH_OF = {
    "balance": {"asset_total_assets": "asset_total_assets_yoy_growth", "liability_total_liabilities": "liability_total_liabilities_yoy_growth"},
    "income": {"total_operating_revenue": "operating_revenue_yoy_growth", "net_profit": "net_profit_yoy_growth"},
    "cash": {"net_cash_flow": "net_cash_flow_yoy_growth"},
}


def with_adjacent_growth(records: DataFrame, sheet: str) -> DataFrame:
    """C-10: growth fields that are missing, zero or beyond 1,000, from a figure and that of the column beside it (<figure>_previous)."""
    out = {}
    for figure, growth in GROWTH_OF[sheet].items():
        if figure in records.columns and f"{figure}_previous" in records.columns:
            before = F.nullif(F.col(f"{figure}_previous"), F.lit(0.0))
            new = (F.col(figure) - before) / F.abs(before) * 100
            old = F.col(growth) if growth in records.columns else F.lit(None).cast("double")
            out[growth] = F.coalesce(F.when((old != 0) & (F.abs(old) <= 1_000), old), new, old)
    return records.withColumns(out)


#: Growth fields of key figures with what their rows' labels hold and don't hold.
KPI_GROWTH = (
    ("operating_revenue_yoy_growth", "营业收入", None),
    ("net_profit_yoy_growth", "归属于上市公司股东的净利润", "扣除非经常性损益"),
    ("net_profit_excl_non_recurring_yoy", "扣除非经常性损益", None),
)


def kpi_growth(grid: DataFrame, third_quarter: Column, limit: float) -> DataFrame:
    """C-11: growth fields of each record from the rows of its grid: in third quarters the last of four or more numbers, else the growth token.
    The first value of at most `limit` in size is taken, else the last one. Records without any row of numbers are left out."""
    rows = stitched(latched(labelled(filled_rows(grid)))).where(F.size("numbers") > 0)
    numbers = F.filter("numbers", lambda t: T.plain_number(t).isNotNull())
    last = F.when(third_quarter & (F.size(numbers) >= 4), T.plain_number(F.get(numbers, F.size(numbers) - 1)))
    rows = rows.withColumn("value", F.coalesce(last, T.growth_token(F.col("numbers"))))
    out = []
    for field, word, other in KPI_GROWTH:
        at = F.when(F.col("label").contains(word) & (~F.col("label").contains(other) if other else F.lit(True)) & F.col("value").isNotNull(), F.col("row_idx"))
        sane = F.when(F.abs("value") <= limit, at)
        out.append(F.coalesce(F.min_by("value", sane), F.max_by("value", at)).alias(field))
    return rows.groupBy("record").agg(*out)
