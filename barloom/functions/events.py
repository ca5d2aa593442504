"""Change-event codes, market-mood labels and rating scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.numeric import _c, lit

# fixed values: change-event codes and their names
CHANGE_NAMES = {
    4: "封涨停板",
    8: "封跌停板",
    16: "打开涨停板",
    32: "打开跌停板",
    64: "有大买盘",
    128: "有大卖盘",
    8193: "大笔买入",
    8194: "大笔卖出",
    8201: "火箭发射",
    8202: "快速反弹",
    8203: "高台跳水",
    8204: "加速下跌",
    8207: "竞价上涨",
    8208: "竞价下跌",
    8209: "高开5日线",
    8210: "低开5日线",
    8211: "向上缺口",
    8212: "向下缺口",
    8213: "60日新高",
    8214: "60日新低",
    8215: "60日大幅上涨",
    8216: "60日大幅下跌",
}
# fixed values: rank lists; the stock-day summary also counts 16 and 32 as bullish
UP_CODES = (4, 64, 8193, 8201, 8202, 8207, 8209, 8211, 8213, 8215)
DOWN_CODES = (8, 128, 8194, 8203, 8204, 8208, 8210, 8212, 8214, 8216)
BULLISH_CODES = UP_CODES + (16, 32)
# fixed values: payload layouts
RATE_FIRST_CODES = (8201, 8202, 8203, 8204, 8207, 8208, 8209, 8210)


def change_name(code) -> Column:
    names = F.create_map(*[v for k, n in CHANGE_NAMES.items() for v in (F.lit(k), F.lit(n))])
    return F.coalesce(names[_c(code)], F.concat(F.lit("类型"), _c(code).cast("string")))


def change_class(code) -> Column:
    return F.when(_c(code).isin(*UP_CODES), "up").when(_c(code).isin(*DOWN_CODES), "down").otherwise("other")


def mood_label(ratio) -> Column:
    """Market mood from the up/down ratio: seven buckets, exactly 1 being one of them."""
    r = _c(ratio)
    return (
        F.when(r >= 2, "普涨(极强)")
        .when(r >= 1.5, "偏强")
        .when(r > 1, "稍强")
        .when(r == 1, "中性")
        .when(r > 0.5, "稍弱")
        .when(r > 0, "偏弱")
        .otherwise("普跌(冰点)")
    )


def up_down_ratio(up, down) -> Column:
    """Ratio of two counts; without losers it is the count of winners."""
    return F.when(_c(down) > 0, _c(up) / _c(down)).otherwise(_c(up).cast("double"))


def rating_score(text) -> Column:
    """Analyst rating text to a score; the order of the tests matters."""
    t = F.lower(F.trim(_c(text)))

    def has(*words):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(t, F.lit(w))
        return cond

    return (
        F.when(has("强烈", "strong", "买入"), lit(75))
        .when(has("推荐", "增持", "buy"), lit(65))
        .when(has("谨慎", "中性", "hold"), lit(50))
        .otherwise(lit(45))
    )


def market_regime(ret) -> Column:
    r = _c(ret)
    return F.when(r >= 0.05, "上涨趋势").when(r <= -0.05, "下跌趋势").otherwise("震荡市")


def split_concepts(text, distinct: bool = True) -> Column:
    """Concept lists come as a JSON array or as delimited text; blanks are dropped."""
    raw = F.trim(_c(text))
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    plain = F.split(F.regexp_replace(raw, "[，、;；]", ","), ",")
    items = F.transform(F.coalesce(parsed, plain), lambda s: F.regexp_replace(F.trim(s), r'^[\[\]"]+|[\[\]"]+$', ""))
    kept = F.filter(items, lambda s: s != "")
    return F.array_distinct(kept) if distinct else kept
