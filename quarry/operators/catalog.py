"""The catalog: duplicates rolled up, records flattened, and text documents built from records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WEEKDAYS, strip
from ..sizes import small


def dedupe_crosslisted(rows: DataFrame, key: str, order: str, listing: list[str]) -> DataFrame:
    """One row a key: the scalars of the row with the least ``order``, and ``cross_listed``, the listings of all rows in order."""
    scalars = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*scalars), F.col(order)).alias("first")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.struct(*listing).alias("item")))), lambda x: x["item"])
    return rows.groupBy(key).agg(first, listed.alias("cross_listed")).select(key, "first.*", "cross_listed")


def flatten_records(records: DataFrame, texts: list[str], arrays: list[str]) -> DataFrame:
    """Records with the length of each text and the size of each array in columns of their own."""
    lengths = {f"{t}_len": F.length(F.coalesce(t, F.lit(""))).cast("long") for t in texts}
    sizes = {f"n_{a}": F.greatest(F.size(a), F.lit(0)).cast("long") for a in arrays}
    return records.withColumns({**lengths, **sizes})


def day_parts(df: DataFrame, sessions: str = "sessions") -> DataFrame:
    """has_morning, has_noon, has_afternoon, has_evening by the sessions' start hours, and the distinct weekdays."""
    some = lambda low, high: F.exists(sessions, lambda s: (s["start_hour"] >= low) & (s["start_hour"] < high))
    return df.withColumns(
        {
            "has_morning": some(8, 12), "has_noon": some(12, 13), "has_afternoon": some(13, 18), "has_evening": some(18, 99),
            "weekdays": F.array_sort(F.array_distinct(F.transform(sessions, lambda s: s["weekday"]))),
        }
    )


def session_text(sessions: Column) -> Column:
    """The sessions in words; hours are not padded."""
    one = lambda s: F.concat(F.lit("星期"), F.substring(F.lit(WEEKDAYS), s["weekday"], F.lit(1)), F.lit(" "), s["start_hour"], F.lit(":00-"), s["end_hour"], F.lit(":00"))
    return F.when(F.coalesce(F.size(sessions) > 0, F.lit(False)), F.array_join(F.transform(sessions, one), "、")).otherwise("未定")


#: Labels of kinds.
KIND_LABELS = {1: "必修課", 2: "選修課", 3: "通識課", 4: "體育課"}


def kind_label(kind: Column, limit: Column) -> Column:
    """The kind's label, and the limit in brackets where there is one."""
    table = F.create_map(*(x for k, v in KIND_LABELS.items() for x in (F.lit(k), F.lit(v))))
    label = F.coalesce(F.try_element_at(table, kind), F.lit("其他"))
    return F.when(F.coalesce(limit, F.lit("")) != "", F.concat(label, F.lit("（"), limit, F.lit("）"))).otherwise(label)


def metadata(df: DataFrame) -> Column:
    """The attributes that filters need, as one struct of fixed fields."""
    return F.struct("course_id", "name", "teacher", "lang", "kind", "lmt_kind", "core", "point", "unit", "time_raw", "sessions")


def doc_base(courses: DataFrame) -> DataFrame:
    text = F.concat(F.lit("課程名稱是"), F.col("name"), F.lit(", 上課時間是"), session_text(F.col("sessions")), F.lit(", 這堂課的老師是"), F.col("teacher"))
    return courses.select("course_id", text.alias("text"), metadata(courses).alias("metadata"))


def doc_objective(courses: DataFrame) -> DataFrame:
    lines = [
        F.concat(F.lit("課名: "), "name"), F.concat(F.lit("教師: "), "teacher"), F.concat(F.lit("開課單位: "), "unit"),
        F.concat(F.lit("語言: "), "lang", F.lit("　學分: "), F.col("point").cast("string")),
        F.concat(F.lit("上課時間: "), session_text(F.col("sessions"))),
        F.concat(F.lit("課程目標: "), F.substring(strip(F.coalesce("objective", F.lit(""))), 1, 600)),
    ]
    return courses.select("course_id", F.concat_ws("\n", *lines).alias("text"), metadata(courses).alias("metadata"))


def doc_enriched(courses: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Records with what an enrichment table (course_id, summary, keywords, topic_tags) knows; lines without content are left out."""
    known = small(enrichment.select("course_id", "summary", "keywords", "topic_tags", F.lit(True).alias("known")))
    both = courses.join(known, "course_id", "left")

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    lines = [
        F.concat(F.lit("課名: "), "name"), F.concat(F.lit("教師: "), "teacher"),
        F.concat(F.lit("開課單位: "), "unit", F.lit("　語言: "), "lang", F.lit("　學分: "), F.col("point").cast("string")),
        F.concat(F.lit("課程類別: "), kind_label(F.col("kind"), F.col("lmt_kind"))),
        F.when(F.col("core") != 0, F.lit("核心通識: 是")),
        F.concat(F.lit("上課時間: "), session_text(F.col("sessions"))),
        line("主題標籤: ", F.array_join("topic_tags", "、")), line("關鍵字: ", F.array_join("keywords", "、")), line("摘要: ", F.col("summary")),
        line("週次主題: ", F.array_join("weekly_topics", "、")),
        line("課程目標: ", F.substring(strip(F.coalesce("objective", F.lit(""))), 1, 400)),
    ]
    return both.select("course_id", F.concat_ws("\n", *lines).alias("text"), metadata(courses).alias("metadata"), F.coalesce("known", F.lit(False)).alias("meta_v1_present"))


#: Document builders by name; the enriched one takes the enrichment table as well.
BUILDERS: dict[str, Callable[..., DataFrame]] = {"d-base": doc_base, "d-obj": doc_objective, "d-v2": doc_enriched}


def prompt(title: Column, tags: Column, body: Column, cut: int = 500) -> Column:
    """A rendered prompt; absent parts get their placeholders."""
    given = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return F.concat_ws("\n", F.concat(F.lit("課名："), given(title, "—")), F.concat(F.lit("標籤："), given(tags, "（無）")), F.concat(F.lit("內容："), given(F.substring(body, 1, cut), "（無）")))


def request_envelope(custom_id: Column, model: str, prompt_text: Column, max_tokens: int = 1024) -> Column:
    """A batch request as JSON."""
    message = F.array(F.struct(F.lit("user").alias("role"), prompt_text.alias("content")))
    body = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), message.alias("messages"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), body.alias("body")))


def given(value: Column, placeholder: str, cut: int | None = None) -> Column:
    """A field of a prompt: cut to some characters, or a placeholder where it is empty."""
    text = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(placeholder))
    return text if cut is None else F.substring(text, 1, cut)


def render(template: str, fields: dict[str, Column]) -> Column:
    """A template with its {names} filled in."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(fields[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p))


def query_prompt_fields(c: dict[str, Column]) -> dict[str, Column]:
    """Fields of the prompt that asks for queries: the objective is cut to 500 characters and the schedule to 300."""
    schedule = F.coalesce(F.nullif(c["schedule"], F.lit("")), c["syllabus"])
    plain = {n: c[n] for n in ("name", "teacher", "unit", "point")}
    return plain | {"lang": given(c["lang"], "—"), "objective": given(c["objective"], "（無）", 500), "schedule": given(schedule, "（無）", 300)}


def metadata_prompt_fields(c: dict[str, Column], tags: list[str]) -> dict[str, Column]:
    """Fields of the prompt that asks for metadata: objective and schedule are cut to 600 characters each, and the allowed tags are listed."""
    schedule = F.coalesce(F.nullif(c["schedule"], F.lit("")), c["syllabus"])
    plain = {n: c[n] for n in ("name", "name_en", "teacher", "point", "lang", "kind", "unit")}
    return plain | {"lmt_kind": given(c["lmt_kind"], "—"), "objective": given(c["objective"], "（無）", 600), "schedule": given(schedule, "（無）", 600), "tags": F.lit("、".join(tags))}
