"""Natural-language queries to typed conditions, as column expressions.

Patterns are matched natively: ``matches`` finds the non-overlapping matches of a pattern with their positions, and
``negated`` asks for a negation word wholly inside a window before a position.  Two parsers
with different rules share them: ``parse_rules`` (search constraints) and ``parse_patterns`` (must and must_not).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONDITIONS, CONSTRAINTS
from .text import strip

# The vocabulary of the queries.
DAYS = "一二三四五六日"
RULE_NEGATIONS = ("不要", "不想", "別", "不開", "排除", "除外", "避開")
PATTERN_NEGATIONS = ("不要", "不含", "不是", "排除", "除了", "沒有", "避免", "非", "不")
RULE_LANGUAGES = (
    ("中文", "中文"), ("國語", "中文"), ("英文", "英文"), ("english", "英文"), ("日文", "日文"), ("日語", "日文"), ("韓文", "韓文"), ("韓語", "韓文"), ("法文", "法文"),
    ("德文", "德文"), ("西班牙文", "西班牙文"), ("西文", "西班牙文"), ("阿拉伯文", "阿拉伯文"), ("土耳其文", "土耳其文"), ("俄文", "俄文"),
)
FOREIGN = ("英文", "日文", "韓文", "法文", "德文", "西班牙文", "阿拉伯文", "土耳其文", "俄文")
TEACHING = ("授課", "教學", "開課", "上課", "授")
DAY_PARTS = (("早八", 8, 9), ("早上", 8, 12), ("上午", 8, 12), ("中午", 12, 13), ("下午", 13, 18), ("晚上", 18, 22), ("晚間", 18, 22), ("夜間", 18, 22))
UNITS = (
    "商學院", "法學院", "文學院", "社科院", "傳院", "理學院", "外語學院", "教育學院", "資科", "資管", "資訊", "企管", "會計", "財管", "金融", "經濟",
    "法律", "法科", "民法", "刑法", "中文系", "英文系", "日文系", "韓文系", "阿拉伯", "斯拉夫", "歐文", "土文", "心理", "社會", "民族", "教育", "新聞", "廣告", "廣電",
    "政治", "外交", "公行", "公共行政", "國關", "統計", "應數", "資工",
)
UNIT_ENDINGS = ("系", "院", "所", "學系", "系所", "學院")
PATTERN_LANGUAGES = ("中文", "英文", "日文", "韓文", "法文", "德文", "西班牙文", "阿拉伯文", "土耳其文", "越南文", "泰文", "印尼文", "俄文")
KIND_WORDS = ("必修", "選修", "通識", "體育")
GENERAL_KINDS = ("外文通識", "社會通識", "人文通識", "自然通識", "資訊通識", "書院通識", "中文通識")
DIGITS = "一二三四五六七八九十"


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def matches(q: Column, pattern: str) -> Column:
    """Non-overlapping matches from the left: array of (at, text), positions from 1.

    One pass finds the texts and one the stretches between them, whose lengths add up to the positions.
    """
    texts, between = F.regexp_extract_all(q, F.lit(pattern), F.lit(0)), F.split(q, pattern, -1)  # the stretch behind the last match has no text
    pairs = F.filter(F.zip_with(texts, between, lambda t, b: F.struct(F.length(b).alias("gap"), t.alias("text"))), lambda m: m["text"].isNotNull())
    start = F.struct(F.array().cast("array<struct<at:int,text:string>>").alias("out"), F.lit(1).alias("free"))

    def step(s: Column, m: Column) -> Column:
        at = s["free"] + m["gap"]
        return F.struct(F.concat(s["out"], F.array(F.struct(at.alias("at"), m["text"].alias("text")))).alias("out"), (at + F.length(m["text"])).alias("free"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def negated(q: Column, at: Column, words: tuple[str, ...] = RULE_NEGATIONS, window: int = 8) -> Column:
    """Whether one of the words lies wholly inside the ``window`` characters before position ``at``."""
    before = F.substring(q, F.greatest(F.lit(1), at - window), F.least(F.lit(window), at - 1))
    return F.exists(_words(words), lambda w: F.contains(before, w))


def _group(m: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(m["text"], f"^(?:{pattern})", i)


def _day(c: Column) -> Column:
    return F.when(c == "天", 7).otherwise(F.instr(F.lit(DAYS), c))


def _sorted(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def _split(found: Column, q: Column, value, words=RULE_NEGATIONS, window: int = 8) -> tuple[Column, Column]:
    """The values of the matches that aren't negated, and of those that are."""
    marked = F.transform(found, lambda m: F.struct(value(m).alias("v"), negated(q, m["at"], words, window).alias("no")))
    take = lambda no: F.transform(F.filter(marked, lambda x: x["no"] == F.lit(no)), lambda x: x["v"])
    return take(False), take(True)


# ---- rules: search constraints ---------------------------------------------------------------------------------

_WEEK = "(?:週|周|星期|禮拜)([一二三四五六日天])(?:\\s*(?:到|至|~)\\s*(?:週|周|星期|禮拜)?([一二三四五六日天]))?"


def rule_weekdays(q: Column) -> tuple[Column, Column]:
    """Days to include and to exclude.  A range runs upwards; a downward one is its start, or nothing where negated."""
    found = matches(q, _WEEK)

    def days(m: Column) -> Column:
        a, b = _day(_group(m, _WEEK, 1)), _day(_group(m, _WEEK, 2))
        return F.when(b == 0, F.array(a)).when(b >= a, F.sequence(a, F.greatest(a, b))).when(negated(q, m["at"]), F.array().cast("array<int>")).otherwise(F.array(a))

    yes, no = _split(found, q, days)
    return _sorted(F.flatten(yes)), _sorted(F.flatten(no))


def _first_places(q: Column, words) -> Column:
    """(word, at) of each word's first place, in the words' order."""
    places = F.transform(_words(words), lambda w: F.struct(w.alias("word"), F.instr(q, w).alias("at")))
    return F.filter(places, lambda p: p["at"] > 0)


def rule_hours(q: Column) -> tuple[Column, Column, Column]:
    """Lower and upper hour, and excluded ranges.  Day parts intersect, which may leave nothing; clock times raise the lower hour."""
    parts = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(a).alias("low"), F.lit(b).alias("high")) for w, a, b in DAY_PARTS))
    found = F.filter(parts, lambda p: F.contains(q, p["word"]))
    no = lambda p: negated(q, F.instr(q, p["word"]))
    kept = F.filter(found, lambda p: ~no(p))
    excluded = F.transform(F.filter(found, no), lambda p: F.struct(p["low"], p["high"]))
    clock = "([0-9]{1,2})\\s*(?::[0-9]{2}|點)"
    hours = F.transform(F.filter(matches(q, clock), lambda m: ~negated(q, m["at"])), lambda m: _group(m, clock, 1).cast("int"))
    hours = F.filter(hours, lambda h: h.between(6, 22))
    low = F.array_max(F.concat(F.transform(kept, lambda p: p["low"]), hours))
    return low, F.array_min(F.transform(kept, lambda p: p["high"])), excluded


def rule_languages(q: Column) -> tuple[Column, Column]:
    """Languages to include and to exclude, by the first place of each keyword."""
    low = F.lower(q)
    table = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(n).alias("name"), F.lit(w in FOREIGN).alias("foreign")) for w, n in RULE_LANGUAGES))
    found = F.filter(table, lambda p: F.contains(low, p["word"]))
    at = lambda p: F.instr(low, p["word"])
    around = lambda p: F.substring(q, F.greatest(F.lit(1), at(p) - 6), F.least(F.lit(6), at(p) - 1) + F.length(p["word"]) + 6)
    taught = lambda p: p["foreign"] | F.exists(_words(TEACHING), lambda t: F.contains(around(p), t))
    yes = F.filter(found, lambda p: ~negated(q, at(p)) & taught(p))
    no = F.filter(found, lambda p: negated(q, at(p)))
    return _sorted(F.transform(yes, lambda p: p["name"])), _sorted(F.transform(no, lambda p: p["name"]))


def rule_points(q: Column) -> tuple[Column, Column]:
    """Lower and upper points; the last mention of each bound counts."""
    pattern = f"([0-9]+|[{DIGITS}])\\s*學分(以上|以下)?"

    def bounds(m: Column) -> Column:
        text = _group(m, pattern, 1)
        n = F.when(F.instr(F.lit(DIGITS), text) > 0, F.instr(F.lit(DIGITS), text).cast("double")).otherwise(text.try_cast("double"))
        return F.struct(F.when(_group(m, pattern, 2) != "以下", n).alias("low"), F.when(_group(m, pattern, 2) != "以上", n).alias("high"))

    found = F.transform(matches(q, pattern), bounds)
    last = lambda side: F.try_element_at(F.array_compact(F.transform(found, lambda b: b[side])), F.lit(-1))
    return last("low"), last("high")


def rule_units(q: Column) -> tuple[Column, Column]:
    """Units to include and to exclude: a unit's first place must be followed at once by a word such as department."""
    found = F.filter(_first_places(q, UNITS), lambda p: F.exists(_words(UNIT_ENDINGS), lambda e: F.substring(q, p["at"] + F.length(p["word"]), F.length(e)) == e))
    yes = F.filter(found, lambda p: ~negated(q, p["at"]))
    no = F.filter(found, lambda p: negated(q, p["at"]))
    return _sorted(F.transform(yes, lambda p: p["word"])), _sorted(F.transform(no, lambda p: p["word"]))


def rule_residual(q: Column, *removed: Column) -> Column:
    """What is left of the query without constraint phrases and the words of ``removed``; the query itself if nothing is."""
    phrases = (
        "(?:不要|不想|別|不開|排除|除外|避開)?(?:週|周|星期|禮拜)[一二三四五六日天]", "早八|早上|上午|中午|下午|晚上|晚間|夜間", "[0-9]{1,2}\\s*(?::[0-9]{2}|點)",
        "[0-9]+\\s*學分(?:以上|以下)?", f"[{DIGITS}]\\s*學分(?:以上|以下)?", "必修|選修|通識|體育|服學|服務學習",
    )
    rest = q
    for p in phrases:
        rest = F.regexp_replace(rest, p, " ")
    for words in removed:
        rest = F.aggregate(words, rest, lambda s, w: F.replace(s, w, F.lit(" ")))
    rest = strip(F.regexp_replace(rest, "(?U)\\s+", " "))
    return F.coalesce(F.nullif(rest, F.lit("")), q)


def parse_rules(q: Column) -> Column:
    """The search constraints of a query; kinds are never set (their words are too ambiguous)."""
    week, hours, lang, points, unit = rule_weekdays(q), rule_hours(q), rule_languages(q), rule_points(q), rule_units(q)
    none = F.array().cast("array<int>")
    return F.struct(
        week[0], week[1], hours[0], hours[1], hours[2], lang[0], lang[1], none, none, points[0], points[1], unit[0], unit[1], rule_residual(q, lang[0], lang[1], unit[0], unit[1])
    ).cast(CONSTRAINTS)


def adapt(c: Column) -> tuple[Column, Column]:
    """Search constraints as must and must_not: the first excluded range, missing hours as 0 and 24, a point range by its lower end."""
    listed = lambda a: F.when(F.size(a) > 0, a)
    hours = F.when(c["hour_min"].isNotNull() | c["hour_max"].isNotNull(), F.array(F.coalesce(c["hour_min"], F.lit(0)), F.coalesce(c["hour_max"], F.lit(24))))
    first = F.get(c["hour_exclude_ranges"], F.lit(0))
    null = F.lit(None)
    must = F.struct(listed(c["lang_include"]), listed(c["weekday_include"]), hours, F.coalesce(c["point_min"], c["point_max"]), null, null, listed(c["unit_include"]))
    must_not = F.struct(listed(c["lang_exclude"]), listed(c["weekday_exclude"]), F.when(first.isNotNull(), F.array(first["low"], first["high"])), null, null, null, null)
    return must.cast(CONDITIONS), must_not.cast(CONDITIONS)


# ---- patterns: must and must_not -------------------------------------------------------------------------------


def _sides(found: Column, q: Column, value) -> tuple[Column, Column]:
    return _split(found, q, value, PATTERN_NEGATIONS, 10)


def _listed(a: Column) -> Column:
    distinct = F.array_distinct(a)
    return F.when(F.size(distinct) > 0, distinct)


def pattern_languages(q: Column) -> tuple[Column, Column]:
    yes, no = _sides(matches(q, "|".join(PATTERN_LANGUAGES)), q, lambda m: m["text"])
    return _listed(yes), _listed(no)


def pattern_weekdays(q: Column) -> tuple[Column, Column]:
    """Ranges first, with or without a prefix; then single days that lie outside them."""
    span = "(?:星期|週|周)?([一二三四五六日天])(?:到|至)(?:星期|週|周)?([一二三四五六日天])"
    one = "(?:星期|週|周)([一二三四五六日天])"
    ranges = matches(q, span)

    def days(m: Column) -> Column:
        a, b = _day(_group(m, span, 1)), _day(_group(m, span, 2))
        return F.when(b >= a, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    singles = F.filter(matches(q, one), lambda m: ~F.exists(ranges, lambda r: (m["at"] >= r["at"]) & (m["at"] < r["at"] + F.length(r["text"]))))
    r_yes, r_no = _sides(ranges, q, days)
    s_yes, s_no = _sides(singles, q, lambda m: _day(_group(m, one, 1)))
    merged = lambda r, s: F.when(F.size(F.concat(F.flatten(r), s)) > 0, _sorted(F.concat(F.flatten(r), s)))
    return merged(r_yes, s_yes), merged(r_no, s_no)


def pattern_hours(q: Column) -> tuple[Column, Column]:
    """The last exact range, else the first named part of the day in the order of the day."""
    exact = "([0-9]{1,2})(?:點|:00)\\s*(?:到|-)\\s*([0-9]{1,2})(?:點|:00)?"
    parts = (("早上|上午", 8, 12), ("中午", 12, 13), ("下午|午後", 13, 18), ("晚上|晚間|夜間", 18, 24))
    e_yes, e_no = _sides(matches(q, exact), q, lambda m: F.array(_group(m, exact, 1).cast("int"), _group(m, exact, 2).cast("int")))
    named = [_sides(matches(q, p), q, lambda m, a=a, b=b: F.array(F.lit(a), F.lit(b))) for p, a, b in parts]
    chosen = lambda exact_, named_: F.coalesce(F.try_element_at(exact_, F.lit(-1)), F.try_element_at(F.concat(*named_), F.lit(1)))
    return chosen(e_yes, [n[0] for n in named]), chosen(e_no, [n[1] for n in named])


def pattern_points(q: Column) -> tuple[Column, Column]:
    """Points of 1 to 4; the last mention counts."""
    plain = q
    for i, c in enumerate("一二三四", 1):
        plain = F.regexp_replace(plain, f"{c}(?=\\s*學分)", str(i))
    pattern = "([1-4](?:\\.0)?)\\s*學分"
    yes, no = _sides(matches(plain, pattern), plain, lambda m: _group(m, pattern, 1).cast("double"))
    return F.try_element_at(yes, F.lit(-1)), F.try_element_at(no, F.lit(-1))


def pattern_kinds(q: Column) -> tuple[Column, Column]:
    """Kinds in a fixed order; names of general-education branches are masked by two blanks first."""
    masked = F.regexp_replace(q, "|".join(GENERAL_KINDS), "　　")
    sides = [_sides(matches(masked, w), masked, lambda m: m["text"]) for w in KIND_WORDS]
    return _listed(F.concat(*(s[0] for s in sides))), _listed(F.concat(*(s[1] for s in sides)))


def pattern_branches(q: Column) -> tuple[Column, Column]:
    sides = [_sides(matches(q, w), q, lambda m: m["text"]) for w in GENERAL_KINDS]
    return _listed(F.concat(*(s[0] for s in sides))), _listed(F.concat(*(s[1] for s in sides)))


def pattern_units(q: Column) -> Column:
    """Units that are wanted: two to six characters and an ending; negated ones and branches are skipped."""
    yes, _ = _sides(matches(q, "[\\x{4e00}-\\x{9fff}]{2,6}(?:系|所|院|中心|學程)"), q, lambda m: m["text"])
    return _listed(F.filter(yes, lambda u: ~F.exists(_words(GENERAL_KINDS), lambda g: F.contains(u, g))))


def parse_patterns(q: Column) -> tuple[Column, Column]:
    """must and must_not of a query."""
    lang, week, hours, point, kind, branch, unit = pattern_languages(q), pattern_weekdays(q), pattern_hours(q), pattern_points(q), pattern_kinds(q), pattern_branches(q), pattern_units(q)
    sides = [F.struct(lang[i], week[i], hours[i], point[i], kind[i], branch[i], unit if i == 0 else F.lit(None)).cast(CONDITIONS) for i in (0, 1)]
    return sides[0], sides[1]


def decode_conditions(response: Column) -> tuple[Column, Column]:
    """must and must_not of a model's answer: the JSON object in the text; anything else gives no conditions."""
    from .text import first_json_object

    both = F.from_json(first_json_object(response), f"struct<must:{CONDITIONS},must_not:{CONDITIONS}>")
    return both["must"], both["must_not"]


# ---- conditions back to text -----------------------------------------------------------------------------------


def expand_query(q: Column, c: Column) -> Column:
    """A query with the words that documents use for its constraints: a single weekday, hours, languages and units."""
    clock = lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
    day = F.when(F.size(c["weekday_include"]) == 1, F.concat(F.lit("星期"), F.substring(F.lit(DAYS), F.get(c["weekday_include"], F.lit(0)), F.lit(1))))
    low, high = c["hour_min"], c["hour_max"]
    middle = F.floor((low + high) / 2).cast("int")
    hours = F.when(low.isNotNull() & high.isNotNull(), F.array_distinct(F.array(low, middle, high))).when(low.isNotNull(), F.array(low))
    parts = F.array_compact(F.array(day, F.array_join(F.transform(hours, clock), " "), F.nullif(F.array_join(F.array_sort(c["lang_include"]), " "), F.lit("")), F.nullif(F.array_join(F.transform(F.array_sort(c["unit_include"]), lambda u: F.concat(u, F.lit("系"))), " "), F.lit(""))))
    return F.when(F.size(parts) > 0, F.concat_ws(" ", q, F.array_join(parts, " "))).otherwise(q)


def condition_prose(must: Column, must_not: Column) -> Column:
    """Conditions in words, dimension by dimension."""
    names = (("course_lang", "語言"), ("weekday", "星期"), ("hour_range", "時段"), ("kind", "類別"), ("lmt_kind", "通識"), ("unit", "單位"))

    def side(c: Column, lead: str) -> Column:
        listed = [F.when(F.size(c[n]) > 0, F.concat(F.lit(f"{lead}{label}="), F.array_join(F.transform(c[n], lambda x: x.cast("string")), "/"))) for n, label in names]
        return F.concat_ws("；", *listed, F.when(c["point"].isNotNull(), F.concat(F.lit(f"{lead}學分="), c["point"].cast("string"))))

    return F.concat_ws("；", F.nullif(side(must, ""), F.lit("")), F.nullif(side(must_not, "不要"), F.lit("")))


#: The parts of a day by their hours, in the order in which a range is looked up.
CONDITION_PARTS = (("morning", 8, 12), ("noon", 12, 13), ("afternoon", 13, 18), ("evening", 18, 24))


def condition_lines(name: Column, unit: Column, must: Column, must_not: Column) -> Column:
    """A gold record and its conditions as lines of a prompt: the record, what a query must ask for, and what it must rule out."""
    quoted = lambda a: F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))

    def side(c: Column, no: str, units: bool) -> Column:
        def labelled(label: str, text: Column) -> Column:
            return F.concat(F.lit(f"{no}{label}="), text)

        days = F.array_join(F.transform(c["weekday"], lambda d: F.concat(F.lit("星期"), F.substring(F.lit(DAYS), d, F.lit(1)))), "、")
        low, high = F.get(c["hour_range"], F.lit(0)), F.get(c["hour_range"], F.lit(1))
        part = F.concat(low, F.lit("-"), high, F.lit("點"))
        for slot, a, b in reversed(CONDITION_PARTS):
            part = F.when((low == a) & (high == b), F.lit(slot)).otherwise(part)
        parts = [
            labelled("授課語言", quoted(c["course_lang"])), F.concat(F.lit("不要=" if no else "星期="), days), labelled("時段", F.concat(part, F.lit("（"), low, F.lit(":00-"), high, F.lit(":00）"))),
            labelled("學分", c["point"].cast("string")), labelled("課程類型", quoted(c["kind"])), labelled("通識類型", quoted(c["lmt_kind"])), *([labelled("系所", quoted(c["unit"]))] if units else []),
        ]
        return F.nullif(F.concat_ws("，", *parts), F.lit(""))

    lines = [F.concat(F.lit("gold課程："), name, F.lit("（"), unit, F.lit("）")), F.concat(F.lit("must（必須）："), side(must, "", True)), F.concat(F.lit("must_not（排除）："), side(must_not, "不要", False))]
    return F.concat_ws("\n", *lines)
