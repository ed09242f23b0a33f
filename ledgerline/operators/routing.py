"""Where a question goes: to the statements, to the reports or to both (L-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a question that ask for a drawing, for reasons, for an industry at large, for a choice of companies, for reports.
CHART = ("可视化", "绘图", "画图", "图表", "柱状图", "折线图", "饼图", "雷达图", "散点图", "直方图", "箱线图")
REASON = ("原因", "归因", "为什么", "驱动", "怎么看", "分析")
INDUSTRY = ("行业", "板块", "景气度", "趋势", "预测", "中药材", "价格波动", "供需", "库存", "种植", "气候")
SCREENING = ("有哪些", "哪些", "哪几家", "前十", "前五", "前三", "最高", "最低", "超过", "高于", "低于", "不低于", "不超过", "统计", "找出", "列出", "筛选", "数量", "所有公司", "各公司", "企业")
REPORTS = ("结合研报", "结合个股研报", "结合行业研报", "检索研报", "研报中", "提取研报", "提取研报观点", "提取观点", "观点", "说明", "风险预警", "判断依据", "依据是什么", "产业升级相关布局")


def routed(questions: DataFrame) -> DataFrame:
    """L-8: questions with intent, needs_sql and needs_retrieval.

    questions: text, top_n, threshold, and arrays companies, metrics, periods, topics of what was found in the text (null: nothing); other columns stay.
    Figures, periods, a number of the best, a threshold or a word of choosing need the statements; all but drawings of figures and plain questions on
    figures need the reports. A null text has no words. A few signals are set first, so that each is computed once."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    says = lambda words: F.coalesce(F.col("text").rlike("|".join(words)), F.lit(False))
    chart, why, wide, strong, named, topical, sql = (F.col(c) for c in ("#chart", "#why", "#wide", "#strong", "#named", "#topical", "needs_sql"))
    signals = {"#chart": says(CHART), "#why": says(REASON), "#wide": says(INDUSTRY), "#strong": says(REPORTS), "#named": some("companies"), "#topical": some("topics")}
    needs = some("metrics") | some("periods") | F.col("top_n").isNotNull() | F.col("threshold").isNotNull() | says(SCREENING)
    intent = (
        F.when(chart & sql & ~why, "sql_chart")
        .when(why, "causal_analysis")
        .when(wide & (~sql | (strong & ~named)), "industry_open_analysis")
        .when(sql & (topical | wide | strong), "hybrid_sql_rag")
        .when(sql, "sql_only")
        .when(named | topical, "rag_only")
        .otherwise("open_analysis")
    )
    out = questions.withColumns(signals | {"needs_sql": needs}).withColumn("intent", intent)
    return out.withColumn("needs_retrieval", ~F.col("intent").isin("sql_chart", "sql_only")).drop(*signals)
