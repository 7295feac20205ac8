"""Tokenizers and token statistics."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lists import read_text
from millrace.plans.durable import durable, fits
from millrace.plans.parts import in_parts
from millrace.plans.registry import operator

#: The Penn Treebank tokenizer's published substitutions, in their order, as (pattern, replacement).
TREEBANK = [
    (r'^"', "`` "), (r"(``)", r" $1 "), (r"([ (\[{<])(\"|'{2})", r"$1 `` "),
    (r"([:,])([^\d])", r" $1 $2"), (r"([:,])$", r" $1 "), (r"\.\.\.", " ... "), (r"[;@#$%&]", r" $0 "),
    (r"([^\.])(\.)([\]\)}>\"']*)\s*$", r"$1 $2$3 "), (r"[?!]", r" $0 "), (r"([^'])' ", r"$1 ' "),
    (r"[\]\[\(\)\{\}<>]", r" $0 "), (r"--", " -- "), (r"$", " "), (r"^", " "), (r'"', " '' "), (r"('')", r" $1 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"$1 $2 "),
    (r"(?i)\b(can)(not)\b", r" $1 $2 "), (r"(?i)\b(d)('ye)\b", r" $1 $2 "), (r"(?i)\b(gim)(me)\b", r" $1 $2 "), (r"(?i)\b(gon)(na)\b", r" $1 $2 "),
    (r"(?i)\b(got)(ta)\b", r" $1 $2 "), (r"(?i)\b(lem)(me)\b", r" $1 $2 "), (r"(?i)\b(more)('n)\b", r" $1 $2 "), (r"(?i)\b(wan)(na)\b", r" $1 $2 "),
    (r"(?i) ('t)(is)\b", r" $1 $2 "), (r"(?i) ('t)(was)\b", r" $1 $2 "),
]


@operator("nltk_tokenizer_mapper", "map")
def nltk_tokenizer_mapper(df: DataFrame, col: Column) -> Column:
    """Treebank word tokens, by its substitutions as built-in expressions: null gives null, an empty text an empty list."""
    for pattern, to in TREEBANK:
        col = F.regexp_replace(col, pattern, to)
    return F.filter(F.split(col, r"\s+"), lambda t: t != "")


#: A few common words, so that segmentation works without a dictionary file; one frequency for all.
COMMON_WORDS = """
我们 你们 他们 她们 自己 什么 怎么 这里 那里 哪里 这个 那个 这样 那样 今天 明天 昨天 现在 以前 以后 时候 时间 天气 北京 上海 中国 美国 世界 国家 城市 社会 经济 政治
文化 历史 科学 技术 教育 学校 学生 老师 大学 学习 工作 公司 企业 市场 产品 服务 问题 方法 情况 发展 研究 分析 管理 生活 生产 电脑 手机 电话 网络 信息 数据 系统
软件 程序 语言 中文 英文 汉语 文字 文章 新闻 报纸 电影 音乐 吃饭 喝水 睡觉 走路 说话 看见 听见 知道 觉得 认为 喜欢 希望 需要 可以 可能 应该 必须 已经 正在 没有
不是 还是 就是 但是 因为 所以 如果 虽然 而且 或者 一个 一些 很多 非常 特别 比较 朋友 孩子 父母 家庭 医院 医生 银行 商店 饭店 火车 飞机 汽车 公园 街道 早上 晚上
""".split()


@lru_cache(4)
def _dictionary(lines: str) -> tuple[dict[str, float], float, int]:
    """Log-frequencies, the logarithm of their sum, and the longest word. Lines: word, frequency."""
    counts = {w: 100.0 for w in COMMON_WORDS}
    for line in lines.splitlines():
        parts = line.split()
        if parts:
            counts[parts[0]] = float(parts[1]) if len(parts) > 1 else 1.0
    return {w: math.log(n) for w, n in counts.items()}, math.log(sum(counts.values())), max(map(len, counts))


#: Han characters; ASCII words and numbers, with a share's sign; signs that may stand in them, together; blanks and other characters one by one.
_RUN = re.compile(r"([㐀-䶿一-鿿豈-﫿]+)|[A-Za-z0-9]+(?:\.[0-9]+)?%?|[+#&._%-]+|\r\n|.", re.DOTALL)


def segment(text: str, lines: str = "") -> list[str]:
    """The split of greatest probability; characters that no word covers stand alone, blanks too. ``lines``: those of a dictionary."""
    logs, total, longest = _dictionary(lines)
    out = []
    for m in _RUN.finditer(text):
        if not m[1]:
            out.append(m[0])
            continue
        run = m[1]
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - longest), end):
                value = logs.get(run[start:end], 0.0 if end - start == 1 else None)
                if value is not None and best[start] + value - total > best[end]:
                    best[end], back[end] = best[start] + value - total, start
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        out += words[::-1]
    return out


@operator("jieba_chinese_tokenizer_mapper", "map")
def jieba_chinese_tokenizer_mapper(df: DataFrame, col: Column, punctuation_filter: bool = True, dictionary_path: str | None = None) -> Column:
    """Chinese words by the most probable split; tokens with punctuation left out on request. Null and empty give null.

    ``dictionary_path``: a file of ``word frequency`` lines, read on the driver and sent to the workers; without it only some common words are known.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_text(dictionary_path) if dictionary_path else "")

    def plain(w):
        return w.isalnum() or w.isspace() or not any(unicodedata.category(c).startswith("P") for c in w)

    def one(t):
        if not t:
            return None
        words = segment(t, sent.value)
        return list(filter(plain, words)) if punctuation_filter else words

    return in_parts("array<string>", lambda texts: pa.array(map(one, texts.to_pylist()), pa.list_(pa.string())))(col)


def _counts(lists: pa.Array, frequency: Callable | None = None) -> pa.Array:
    """Of each list the distinct tokens in order of first occurrence, how often each occurs, and its ``frequency`` if that is given."""
    found = [None if x is None else Counter(x) for x in lists.to_pylist()]
    made = {"token": pa.array([None if c is None else list(c) for c in found], pa.list_(pa.string())), "tf": pa.array([None if c is None else list(c.values()) for c in found], pa.list_(pa.int64()))}
    if frequency:
        made["df"] = pa.array([None if c is None else list(map(frequency, c)) for c in found], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays(list(made.values()), list(made))


def _counted(col: Column) -> Column:
    """The distinct tokens in order of first occurrence, and how often each occurs."""
    return in_parts("token array<string>, tf array<bigint>", _counts)(col)


#: Distinct tokens whose frequencies are sent to the workers, 16 MB of them at most.
SENT_TOKENS = 1_000_000


def _with_frequencies(df: DataFrame, col: Column, known: DataFrame) -> DataFrame:
    """``df`` with ``list_`` of (pos, token, tf, df). Few distinct tokens: sent to the workers, so no row is shuffled; else joined."""
    parts = lambda c: F.arrays_zip(F.col(f"{c}.token").alias("token"), F.col(f"{c}.tf").alias("tf"))
    if not fits(known, SENT_TOKENS):
        rows = durable(df.withColumn("row_", F.monotonically_increasing_id()).withColumn("counted_", _counted(col)))
        each = rows.select("row_", F.posexplode(parts("counted_")).alias("pos", "x")).select("row_", "pos", "x.*")
        met = each.join(known.withColumnRenamed("token", "token_"), F.col("token").eqNullSafe(F.col("token_")))
        lists = met.groupBy("row_").agg(F.collect_list(F.struct("pos", "token", "tf", "df")).alias("list_"))
        return rows.join(lists, "row_", "left").drop("row_", "counted_")
    table = known.toArrow()
    sent = df.sparkSession.sparkContext.broadcast(dict(zip(table.column("token").to_pylist(), table.column("df").to_pylist(), strict=True)))

    looked_up = in_parts("token array<string>, tf array<bigint>, df array<bigint>", lambda lists: _counts(lists, sent.value.__getitem__))
    met = df.withColumn("found_", looked_up(col))
    zipped = F.arrays_zip(*(F.col(f"found_.{c}").alias(c) for c in ("token", "tf", "df")))
    listed = F.transform(zipped, lambda x, i: F.struct(i.alias("pos"), x["token"].alias("token"), x["tf"].alias("tf"), x["df"].alias("df")))
    return met.withColumn("list_", listed).drop("found_")


@operator("tfidf_mapper", "table")
def tfidf_mapper(df: DataFrame, field: str, output_field: str) -> DataFrame:
    """``array<struct<token, tf, df, tfidf>>``, by tfidf falling, then by first occurrence; null arrays give empty ones.

    tfidf = round(tf * (ln(N / (df + 1)) + 1), 4). Document frequencies are counted from each row's distinct tokens, combined map-side.
    """
    col = F.col(f"`{field}`")
    n = df.count()
    # explode_outer: the lists are neither null nor empty, and explode would count them twice to see that
    each = df.filter(F.size(col) > 0).select(F.explode_outer(_counted(col)["token"]).alias("token"))
    known = durable(each.groupBy("token").agg(F.count("*").alias("df")))
    score = lambda x: F.bround(x["tf"] * (F.log(F.lit(float(n)) / (x["df"] + 1)) + 1), 4)
    scored = F.transform("list_", lambda x: F.struct((-score(x)).alias("by"), x["pos"].alias("pos"), x["token"].alias("token"), x["tf"].alias("tf"), x["df"].alias("df"), score(x).alias("tfidf")))
    made = F.transform(F.sort_array(scored), lambda x: F.struct(x["token"].alias("token"), x["tf"].alias("tf"), x["df"].alias("df"), x["tfidf"].alias("tfidf")))
    empty = F.array().cast("array<struct<token:string,tf:bigint,df:bigint,tfidf:double>>")
    return _with_frequencies(df, col, known).withColumn(output_field, F.coalesce(made, empty)).drop("list_")


#: Traditional characters and, at the same place, the simplified ones.
TRADITIONAL = "義雲這裡輸轉換內國學會說話語讀書寫電腦網絡車馬魚鳥龍門開關問間時東西長張風飛機場買賣錢銀鐵鐘錶華萬與為從來對錯題類頭髮體點燈無愛慶憶應樂業機構標準樣權條極橋樓歲歷壓廠廣庫廟嚴單雙發變號葉聽聲聯腳臉艦藝蘇藥處虛蟲衛補裝製複見規視覺觀記許設訪證評試詩詳請論講謝識警護變讓貝負財貨質費資賓賽趕跡軍軟較輕輪農達進運過還邊郵醫釋鄉錄鏡陽陰陳隊階際陸隱難雜雞離靈靜頁順須領頻顏願顯飯飲館驗驚髒鬥鮮麗麥黃齊齒"
SIMPLIFIED = "义云这里输转换内国学会说话语读书写电脑网络车马鱼鸟龙门开关问间时东西长张风飞机场买卖钱银铁钟表华万与为从来对错题类头发体点灯无爱庆忆应乐业机构标准样权条极桥楼岁历压厂广库庙严单双发变号叶听声联脚脸舰艺苏药处虚虫卫补装制复见规视觉观记许设访证评试诗详请论讲谢识警护变让贝负财货质费资宾赛赶迹军软较轻轮农达进运过还边邮医释乡录镜阳阴陈队阶际陆隐难杂鸡离灵静页顺须领频颜愿显饭饮馆验惊脏斗鲜丽麦黄齐齿"


@operator("chinese_traditional_to_simple_mapper", "map")
def chinese_traditional_to_simple_mapper(df: DataFrame, col: Column, table_path: str | None = None) -> Column:
    """Traditional Chinese in simplified characters; empty becomes null.

    ``table_path``: a file of ``traditional simplified`` lines, phrases too, of which the longest match is taken; without
    it a table of common characters is used, as one built-in expression.
    """
    if table_path is None:
        pairs = {a: b for a, b in zip(TRADITIONAL, SIMPLIFIED, strict=True) if a != b}
        return F.when(F.length(col) > 0, F.translate(col, "".join(pairs), "".join(pairs.values())))
    pairs = dict(zip(TRADITIONAL, SIMPLIFIED, strict=True)) | dict(p[:2] for line in read_text(table_path).splitlines() if len(p := line.split()) >= 2)

    @F.pandas_udf("string")
    def simple(texts: pd.Series) -> pd.Series:
        longest_first = re.compile("|".join(map(re.escape, sorted(pairs, key=len, reverse=True))))
        return texts.map(lambda t: longest_first.sub(lambda m: pairs[m[0]], t) if t else None)

    return simple(col)
