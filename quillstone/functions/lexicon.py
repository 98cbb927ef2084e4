"""Word lists and patterns that the scores read. All are data: a score takes a Lexicon, and any language can have one."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """Lists are patterns without look-around, so that all engines read them alike."""

    formulaic: tuple[str, ...]
    official: tuple[str, ...]
    skeleton: tuple[str, ...]
    connectives: tuple[str, ...]
    connective_heads: str
    wide_connective_heads: str
    nominal_suffix: str
    abstract: str
    personal: str
    subjective: str
    concrete: str
    idioms: str
    long_idioms: str
    modal: str
    span_modal: str
    vague: str
    colloquial: str
    triple: str
    mixed_spacing: str
    spacing_before: str
    judgement_tail: str
    span_judgement_tail: str
    question: str
    pause: str
    marks: str
    delimiters: str
    span_delimiters: str
    ignore: str
    pads: tuple[str, ...]


#: Lists and patterns whose content decides the scores of Chinese prose.
CHINESE = Lexicon(
    formulaic=(
        "值得注意的是", "值得一提", "毋庸置疑", "不可否认", "众所周知", "归根结底", "归根到底", "综上所述", "总而言之", "总的说来", "总的来说", "简而言之",
        "一言以蔽之", "由此可见", "在当今社会", "随着.{0,6}的发展", "具有重要.{0,6}意义", "发挥着.{0,6}作用", "至关重要", "不可或缺", "应运而生", "大势所趋",
        "势在必行", "任重道远", "日益凸显", "与日俱增", "方兴未艾", "不仅.{0,4}而且", "既.{0,8}又.{0,8}也", "一方面.{0,8}另一方面", "赋能", "抓手", "闭环", "落地",
        "层面", "维度", "赛道", "生态", "矩阵", "颗粒度", "打法", "组合拳",
    ),
    official=(
        "高位推动", "顶层设计", "压茬推进", "挂图作战", "攻坚克难", "久久为功", "锚定", "紧扣", "牛鼻子", "先手棋", "最后一公里", "加速度", "夯实", "筑牢", "厚植",
        "盘活", "补齐", "锻造", "擦亮", "织密", "纾困", "注入新动能", "激发新活力", "释放新潜力", "凝聚共识", "形成合力", "拓宽渠道", "搭建平台", "新台阶", "新征程",
        "擘画", "落地", "闭环", "对齐", "颗粒度", "护城河", "飞轮", "赋能", "抓手", "维度", "举措", "效能", "路径", "机制", "体系", "格局",
    ),
    skeleton=("首先", "其次", "再次", "其一", "其二", "其三", "一方面", "另一方面", "总之", "综上", "总的来说", "简而言之", "第[一二三四五六七八九十]+[章节部点条]"),
    connectives=("然而", "因此", "此外", "与此同时", "更重要的是", "不仅如此", "换言之", "事实上", "实际上", "从而", "进而", "反之", "尽管如此", "由此可见", "这意味着"),
    connective_heads="然而|因此|此外|与此同时|更重要的是|不仅如此",
    wide_connective_heads="然而|因此|此外|与此同时|更重要的是|不仅如此|换言之|事实上|实际上",
    nominal_suffix="(性|化|度|感|力|型|式|机制|体系|格局|举措|效能|路径|维度|层面)$",
    abstract="性|化|度|机制|体系|格局",
    personal="(我|我们|咱|你|您|我觉得|个人|身边|记得|那次|当时|小时候|昨天|上周|我家|朋友)",
    subjective="我|我们|咱|那次|当时|记得|小时候|朋友",
    concrete="([0-9０-９]+[年月日%％元块个次万亿度公里分秒]|[一二三四五六七八九十百千万亿两几]{1,3}[块元个年月天次度岁遍]|[A-Za-z][A-Za-z0-9-]{2,}|第[一二三四五六七八九十]+[章节部])",
    idioms="[一-龥]{4}(?:、[一-龥]{4}){1,}",
    long_idioms="[一-龥]{4}(?:、[一-龥]{4}){2,}",
    modal="(应该|应当|必须|需要|有助于|意味着|表明|说明|能够|可以|我们要|值得注意的是|不仅|而且|既要|也要)",
    span_modal="(应该|应当|必须|需要|有助于|意味着|表明|说明|能够|可以|我们要|既要|也要|不仅|而且)",
    vague="(我们每个人|我们应当|我们要|人们|大家|每个人|一个人|任何人都|双方均|各方应)",
    colloquial="(吧|啊|呢|嘛|呗|啦|说实话|其实|反正|倒是|压根|就这么|怎么说|那会儿|挺|贼|忒)",
    triple="(既要.{2,12}也要|不仅.{2,12}而且.{2,12}还|一方面.{2,12}另一方面)",
    mixed_spacing="[一-龥][ \t]+[A-Za-z0-9]|[A-Za-z0-9][ \t]+[一-龥]",
    spacing_before="[一-龥][ \t]+[A-Za-z0-9]",
    judgement_tail="是.*的。?$",
    span_judgement_tail="是.*的[。！？!?；;]? *$",
    question="[？?]",
    pause="[…—]",
    marks="[，。！？；：、…—]",
    delimiters="。！？!?；;",
    span_delimiters="。！？!?；;",
    ignore="，,、",
    pads=("说实话", "其实", "老实说", "说白了"),
)

#: For the test tables, whose prose is invented in four languages of Latin script.
LATIN = Lexicon(
    formulaic=("of the", "in the", "and the", "de la", "in der", "que de"),
    official=("tion", "ment", "heit", "ción", "the"),
    skeleton=("The", "Les", "Die", "Los", "And", "Of"),
    connectives=("and", "und", "et", "que", "that", "with"),
    connective_heads="And|Und|Et|Que|That",
    wide_connective_heads="And|Und|Et|Que|That|With|Of",
    nominal_suffix="(tion|ment|heit|keit|ción|ing)$",
    abstract="tion|ment|heit|ción",
    personal=" (?:he|it|is|le|der|el) ",
    subjective=" (?:he|it|le|el) ",
    concrete="([0-9]+|[A-Z][a-z]{7,})",
    idioms="[a-z]{4}(?:, [a-z]{4}){1,}",
    long_idioms="[a-z]{4}(?:, [a-z]{4}){2,}",
    modal=" (?:was|be|are|est|ist|en) ",
    span_modal=" (?:was|be|are|est|ist) ",
    vague=" (?:this|les|die|los) ",
    colloquial=" (?:oh|ou|on|ja) ",
    triple="(as.{2,12}as|et.{2,12}et)",
    mixed_spacing="[a-z][ \t]+[0-9]|[0-9][ \t]+[a-z]",
    spacing_before="[a-z][ \t]+[0-9]",
    judgement_tail="is .*[.]$",
    span_judgement_tail="is .*[.] *$",
    question="[?]",
    pause="[…—-]",
    marks="[,.!?;:…—|-]",
    delimiters=".!?;",
    span_delimiters=".!?;",
    ignore=",|",
    pads=("with", "from", "avec", "para"),
)
