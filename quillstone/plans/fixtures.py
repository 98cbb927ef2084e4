"""Small tables given in full, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[str, tuple[str, list[tuple]]] = {
    "zh_docs": (
        "doc_id BIGINT, text STRING",
        [
            (1, "值得注意的是，数字化转型已成为大势所趋。首先，企业要夯实顶层设计，完善治理体系。其次，应当凝聚共识、形成合力、搭建平台。因此，必须久久为功，推动高质量发展迈上新台阶。综上所述，这是一项具有重要战略意义的系统工程，需要各方共同努力才能够实现的。"),
            (2, "昨天我去菜场，碰见老张。他说西红柿3块5一斤，我没还价就买了两斤。\n回家一尝，酸！不过炖牛腩倒是挺合适的。你说怪不怪？"),
            (3, "“你怎么才来？”她问。\n“路上堵了40分钟，”我喘着气，“手机也没电了。”\n她没说话……只是把伞递过来。"),
            (4, "各单位要提高认识，压实责任。一方面抓好落实，另一方面强化监督。既要攻坚克难，也要久久为功。使用 AI 工具 3 次以上的，需要登记。"),
            (5, ""),
            (6, "首先是目标明确、重点突出、措施有力、责任到人的工作机制建设。然而人们往往忽视这一点。"),
        ],
    ),
    "zh_pairs": (
        "doc_id BIGINT, original STRING, rewritten STRING",
        [
            (-1, "2023年GDP增长5.2%，其中AI产业贡献23%。", "2023年增长5.2%，其中产业贡献32%，约7成。"),
            (-2, "人工智能技术展望未来，前景广阔。企业需要Fast-API接口。", "人工智能技术吧，前景广阔。企业需要fast-api接口。"),
            (-3, "【场景：会议室】\n# 开场\n张总（项目经理）：开始吧。\n李工（前端负责人）：好。", "张总：开始吧。\n李工：好。"),
            (-4, "首先要明确目标，其次要落实责任。", "其次要落实责任。"),
            (-5, "企业应当重视培训。", "这事儿我见过，我们公司去年我带的培训，说白了就是我朋友讲，我听。"),
            (-6, "随着城市化进程不断推进，公共服务体系的建设已经成为各地政府普遍关注的重点任务之一，也关系到每一位居民的日常生活质量与长远发展，需要各方共同努力。", "城市化。公共服务体系的建设"),
            (-7, "数据安全治理体系建设是重点。", "数据安全。治理体系建设是重点。"),
            (-8, "没有变化的一段话。", "没有变化的一段话。"),
            (-9, "有内容。", ""),
        ],
    ),
    "cliche_docs": (
        "doc_id BIGINT, text STRING",
        [
            (-1, "值得注意的是，数字化转型具有十分重要的现实意义。然而，困难不少。\n因此企业要站在新的历史起点上，展望未来。"),
            (-2, "说真的，这事说真的，不好办。讲真，说真的，再等等——不急——真的——好吗……行……吧"),
            (-3, "综上所述，毋庸置疑，他总体而言，不差！与此同时而且，另外走了。"),
        ],
    ),
    "score_docs": (
        "doc_id BIGINT, text STRING",
        [
            (1, "值得注意的是，企业要转型。综上所述，未来可期。然而，面对机遇和挑战，我们站在新的历史起点上，必须在新时代背景下取得了显著成效。"),
            (2, "说真的，其实说白了，在当前背景下，企业要转型。讲真，老实讲，数字化转型不是一蹴而就的。你懂的。就这样。"),
            (3, "增长达到了 41.8%嗯。说到底。换句话说。再去年的数据，时候候不早了。搭起弄全之后，贼好。"),
            (4, "今天天气不错。我们去公园走走吧，顺便买点菜。\n回来再说——别急——慢慢来……行……"),
            (5, ""),
            (6, None),
            (7, "共 100 次,用 GPU 跑,很快,很稳，结束。一二三四五六。一二三四五六七。一二三四五六。一二三四五六七。一二三四五六。说真的，好。说真的，行。"),
            (8, "长" * 52 + "。" + "长" * 70 + "。" + "长" * 61 + "；不仅要讲创新而且要讲落实还要见效。"),
        ],
    ),
    "tracks": ("track STRING, a DOUBLE, b DOUBLE, sat DOUBLE", [("main", 2.014, 19.06, 40.2), ("narrative", 1.716, 18.33, 47.6), ("dialogue", 0.8827, 26.5, 83.3), ("human", -0.3, 18.0, None)]),
    "scored": ("id BIGINT, genre STRING, score BIGINT", [(1, "main", 0), (2, "narrative", 12), (3, "dialogue", 90), (4, "humanHand", 30), (5, None, 60), (6, "main", 20), (7, "humanHand", 90)]),
    "scale": ("id BIGINT, kind STRING, score BIGINT", [(1, "human", 26), (2, "human", 7), (3, "machine", 30), (4, "machine", 62)]),
    "spaced": (
        "doc_id BIGINT, original STRING, rewritten STRING",
        [(1, "使用 Webpack 打包", "用Webpack打包1200个模块"), (2, "使用Webpack打包", "用Webpack打包"), (3, "增长 \t5 %  左右，GDP)  好", "增长5%左右"), (4, "", "")],
    ),
    "nll_windows": (
        "doc_id BIGINT, win BIGINT, scored BIGINT, mean_nll DOUBLE",
        [(1, 0, 40, 0.52), (1, 1, 40, 0.55), (1, 2, 30, 0.57), (2, 0, 59, 0.61), (3, 0, 60, 0.70), (3, 1, 61, 0.9), (4, 0, 80, 0.4), (4, 1, 0, 0.1), (4, 2, 64, 0.8), (4, 3, 64, 0.3)],
    ),
    "layers": ("doc_id BIGINT, surface DOUBLE, semantic DOUBLE", [(1, 20.0, 80.0), (2, 55.5, 54.0), (3, 0.0, 100.0), (4, 47.0, 47.0)]),
    "judgements": (
        "doc_id BIGINT, seat STRING, weight BIGINT, score BIGINT, critique STRING",
        [(1, "a", 2, 40, "句式过于整齐"), (1, "b", 1, 70, "句式单一"), (1, "c", 1, 55, "套话多"), (2, "a", 2, 10, "自然"), (2, "b", 1, 30, "套话多"), (3, "a", None, 25, "空泛"), (3, "b", 3, 26, "空泛"), (3, "c", 1, 90, "空泛")],
    ),
    "calib_points": (
        "track STRING, x DOUBLE, y DOUBLE",
        [("main", 20.0, 12.0), ("main", 35.0, 40.0), ("main", 50.0, 61.0), ("main", 64.0, 90.0), ("main", 41.0, 47.0), ("main", 28.0, 33.0), ("main", 58.0, 71.0), ("main", 70.0, 88.0), ("dialogue", 10.0, 5.0), ("dialogue", 30.0, 44.0), ("human", 8.0, 3.0), ("flat", 15.0, 20.0), ("flat", 15.0, 30.0)],
    ),
    "samples": (
        "id BIGINT, local DOUBLE, semantic DOUBLE, official DOUBLE",
        [(1, 20.0, 55.0, 50.0), (2, 40.0, 80.0, 77.0), (3, 35.0, 20.0, 24.0), (4, 60.0, 90.0, 85.0), (5, 10.0, 5.0, 3.0), (6, 44.0, 61.0, 63.0), (7, 25.0, 70.0, 60.0), (8, 51.0, 33.0, None), (9, 33.0, None, 40.0)],
    ),
    "baseline": ("id STRING, want DOUBLE, score DOUBLE, direction STRING", [("a", 20.0, 24.0, "down"), ("b", 60.0, 58.0, "up"), ("c", 30.0, 30.0, "down"), ("d", 27.0, 63.0, "down"), ("e", 80.0, 81.0, "up")]),
    "external": ("id STRING, source STRING, local DOUBLE, score DOUBLE", [("a", "one", 20.0, 62.0), ("a", "two", 20.0, 90.0), ("b", "one", 45.0, 80.0), ("b", "two", 30.0, 60.0), ("c", "one", 50.0, 60.0)]),
    "stages": (
        "run BIGINT, seq BIGINT, id STRING, ms DOUBLE, chars BIGINT, skipped BOOLEAN",
        [(1, 0, "start", 0.0, 500, False), (1, 1, "vocab", 2.5, 520, False), (1, 2, "split", 1.0, 515, False), (1, 3, "vocab", 0.5, 516, False), (1, 4, "caps", 0.0, 516, True), (2, 0, "start", 0.0, 90, False), (2, 1, "vocab", 0.25, 90, True), (2, 2, "split", 0.5, 84, False)],
    ),
    "ledger": (
        "line BIGINT, id STRING, url STRING, pct DOUBLE, label STRING, sha STRING",
        [(1, "a", "u1", 70.0, "ai", "s1"), (2, "b", "u2", 35.0, "suspected", "s2"), (3, "c", None, 10.0, "human", "s3"), (4, "a", "u1", 71.0, "ai", "s4"), (5, "d", "u5", 10.0, "ai", "s5"), (6, "z", "u6", 120.0, "ai", "s6")],
    ),
    "ledger_old": ("line BIGINT, sha STRING", [(1, "s1"), (2, "s2"), (3, "s3x"), (4, "s4"), (5, "s5"), (6, "s6"), (7, "s7")]),
    "candidates": ("doc_id BIGINT, candidate BIGINT, score BIGINT, vetoed BOOLEAN", [(1, 0, 40, False), (1, 1, 22, True), (1, 2, 25, False), (1, 3, 25, False), (2, 0, 30, True), (2, 1, 12, True), (3, 0, 18, False), (3, 1, 19, False)]),
    "rounds": ("doc_id BIGINT, round BIGINT, anchor BIGINT, score BIGINT, issues STRING, critiques STRING", [(1, 0, 80, 80, "a", "x,y"), (1, 1, 80, 60, "a", "y,z"), (1, 2, 80, 55, "a,b", "z,w"), (2, 0, 24, 24, "", "x"), (2, 1, 24, 20, "", "k"), (3, 0, 60, 60, "a", "x,y,z"), (3, 1, 60, 61, "a", "x,y"), (4, 0, 70, 70, "a", ""), (4, 1, 70, 50, "", "q"), (4, 2, 70, 60, "a", "r"), (4, 3, 70, 49, "b", "r"), (5, 0, 90, 90, "", "m,n"), (5, 1, 90, 70, "", ""), (5, 2, 90, 60, "", "n,m")]),
    "raw_scores": ("id BIGINT, raw STRING", [(1, '{"data":{"score":0.83}}'), (2, '{"data":{"score":27}}'), (3, '{"status":"error","data":{"score":0.2}}'), (4, '{"data":{}}'), (5, '{"data":{"score":"x"}}'), (6, '{"data":{"score":140}}')]),
    "official_results": ("id BIGINT, said STRING", [(1, "检测结果：AI特征 87.5%"), (2, "人工特征"), (3, "疑似AI 占比 41%"), (4, "AI特征"), (5, "无结果"), (6, "label: 12 %")]),
}


def table_of(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = _TABLES[name]
    return spark.createDataFrame(rows, schema)


def _value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)


def sql_table(name: str) -> str:
    """The same rows as a SELECT of the oracle's SQL."""
    schema, rows = _TABLES[name]
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1].replace("STRING", "VARCHAR") for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    picked = ", ".join(f'CAST("{c}" AS {k}) AS "{c}"' for c, k in zip(columns, kinds))
    quoted = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT {picked} FROM (VALUES {values}) AS v({quoted})"
