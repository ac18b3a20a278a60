"""Schemas as DDL strings: what columns mean is in the operators' docstrings."""

SESSIONS = "array<struct<weekday:int,start_hour:int,end_hour:int>>"
CONSTRAINTS = (
    "struct<weekday_include:array<int>,weekday_exclude:array<int>,hour_min:int,hour_max:int,hour_exclude_ranges:array<struct<low:int,high:int>>,"
    "lang_include:array<string>,lang_exclude:array<string>,kind_include:array<int>,kind_exclude:array<int>,point_min:double,point_max:double,"
    "unit_include:array<string>,unit_exclude:array<string>,residual:string>"
)
CONDITIONS = "struct<course_lang:array<string>,weekday:array<int>,hour_range:array<int>,point:double,kind:array<string>,lmt_kind:array<string>,unit:array<string>>"
ENRICHMENT = "course_id string, summary_100 string, keywords_json string, topic_tags_json string, model string, generated_at timestamp, raw_json string"
EVAL_ROWS = "qid string, query string, type string, source string, gold array<string>, gold_course_id string"
