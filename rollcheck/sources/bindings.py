"""The driver's tables as registry, documents, records, pages, issues and evaluation cases.

Each view is SQL that Spark and DuckDB both run, so the same text serves a query and its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")

#: Of the session views, so that a user's own views keep their names.
PREFIX = "rollcheck_"

VIEWS = {
    "fx_expectations": "select cast(floor(o_orderkey/500) as int) part_number, 1 serial_start, 500 serial_end, 500 expected_total from orders group by 1",
    "fx_documents": """select part_number*10+v doc_id, part_number, lang, v in (1,2,4) active_version, case when v<=4 then 'r1' else 'r0' end revision_id,
 concat('roll-',cast(part_number as string),'-',lang,'-',cast(v as string),'.pdf') filename, 17 pages, 500+cast(part_number%3 as int)-v expected_total,
 case when (part_number+v)%9=0 then 'processing' when (part_number+v)%4=0 then 'completed_with_warnings' else 'completed' end processing_status
 from fx_expectations cross join (values ('en',1),('te',2),('te',3),('ur',4),('en',5),('te',6),('ur',7)) e(lang,v)""",
    "fx_records": """select *, cast(floor((try_cast(serial_number as int)-1)/30) as int)+1 page
 from (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) record_id,
 cast(floor(l_orderkey/500) as int)*10 + l_linenumber doc_id, cast(floor(l_orderkey/500) as int) part_number,
 case when l_partkey%97=0 then null when l_partkey%89=0 then concat('S',l_orderkey%500+1)
      when l_partkey%83=0 then cast(l_orderkey%500+501 as string) else cast(l_orderkey%500+1 as string) end serial_number,
 case when l_linenumber in (1,5) then 'en' when l_linenumber in (4,7) then 'ur' else 'te' end lang,
 case when l_partkey%7=0 then null when l_partkey%13=0 then concat('XYZ',lpad(cast(l_orderkey as string),7,'0')) else concat('ABC',lpad(cast(l_orderkey as string),7,'0')) end ident,
 case when l_suppkey%11=0 then null when l_suppkey%17=0 then ' 9 - 9 ' else cast(cast(floor((l_orderkey%500)/(1+floor(l_orderkey/500)%8)) as int) as string) end house,
 cast(15+(l_orderkey*7)%112 as int) + case when l_partkey%10=0 then 1 else 0 end age,
 case when l_orderkey%19=0 then null when l_linenumber=2 and l_partkey%4=0 then case l_orderkey%2 when 0 then 'పురుషుడు' else 'స్త్రీ' end else case l_orderkey%2 when 0 then 'Male' else ' FEMALE ' end end gender,
 case when l_partkey%41=0 then null when l_linenumber in (2,3,6) then concat('రామ ', cast(l_orderkey%700 as string)) else concat('Person  ', cast(l_orderkey%700 as string), ' of Place ', cast(l_orderkey%50 as string)) end name,
 case l_partkey%5 when 0 then 'Father' when 1 then 'Mother' when 2 then 'Husband' when 3 then 'Guardian' else 'Other' end relation_type,
 case when l_suppkey%37=0 then ' ' else concat('Elder ', cast(l_orderkey%90 as string)) end relation_name,
 case when l_linestatus='F' and l_partkey%3=0 then 'verified' when l_partkey%10=3 then 'requires_review' else 'unverified' end verification_status,
 l_linestatus, l_shipdate created_at, cast(60+cast(round(l_tax*100) as int)*5 as double) conf
 from lineitem) b""",
    "fx_pages": """select doc_id, part_number, page, page + case when page%5=0 then 1 else 0 end printed_page,
 case when page%5=1 then 'requires_review' when page%7=0 then 'failed' else 'processed' end status,
 case when page%11=0 and doc_id%3=0 then 'page_persistence_failed' when page%3=1 then 'page_processing_failed' when page%4=0 then 'low_text' end error_type,
 case when page%6=0 then null when (doc_id+page)%4=0 then 'ur' when (doc_id+page)%4<3 then 'te' else 'en' end detected_language,
 cast(n + case when page%6=0 then 1 else 0 end as int) records_detected, cast(n as int) records_extracted, cast(k as int) records_review
 from (select doc_id, part_number, page, count(*) n, sum(case when verification_status='requires_review' then 1 else 0 end) k
       from fx_records where try_cast(serial_number as int) between 1 and 500 group by 1,2,3) p""",
    "fx_issues": """select e.event_id issue_id, cast(floor(e.event_id/500) as int)*10+1+cast(e.event_id%7 as int) doc_id, cast(e.event_id%17 as int)+1 page, r.record_id,
 case when e.event_id%13=0 then 'serial_gap' when e.event_id%17=0 then 'malformed_record' when e.event_id%19=0 then 'language_incomplete' else
 case e.event_type when 'error' then 'page_failure' when 'signup' then 'missing_serial' when 'purchase' then 'low_confidence' when 'view' then 'possible_duplicate' else 'language' end end issue_type,
 case e.event_type when 'purchase' then 'informational' when 'click' then 'needs_review' else 'critical' end severity,
 case e.event_id%5 when 0 then 'resolved' when 1 then 'dismissed' else 'open' end status,
 concat(e.event_type,' user ',cast(e.user_id as string)) issue_detail, e.ts created_at
 from events e left join (select l_orderkey, min(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int))) record_id
      from lineitem group by l_orderkey) r on r.l_orderkey=e.event_id""",
    "fx_gold": """select p_partkey case_id, cast(p_partkey%4+1 as int) part_number, case p_partkey%2 when 0 then 'en' else 'te' end lang,
 cast(p_partkey as string) serial_number, concat('ABC',lpad(cast(p_partkey as string),7,'0')) ident,
 case p_partkey%2 when 0 then p_name else concat('రామ ',p_name) end name, cast(18+p_partkey%60 as string) age,
 case when p_partkey%8=0 then null else concat(p_type, '  ', p_brand) end relation_name, case p_partkey%3 when 0 then 'Father' when 1 then 'Husband' else 'Mother' end relation_type,
 concat(cast(p_size as string), '-', cast(p_partkey%9 as string)) house, case p_partkey%2 when 0 then 'Male' else 'Female' end gender from part""",
    "fx_observations": """select case_id, config_id, cast(case when config_id='b' and case_id%4=0 then 1 else 0 end as int) retry_count, cast(10+case_id%7 as double) runtime_ms, cast(100+case_id%50 as double) memory_mb,
 case when case_id%23=0 and config_id='a' then 'crop_out_of_page' when case_id%29=0 then 'invalid_value' when case_id%31=0 then 'timeout' end failure_code,
 serial_number, case when case_id%11=0 then null when case_id%5=0 and config_id='a' then replace(ident,'B','8') else ident end ident,
 case when case_id%3=0 and config_id='a' then replace(name,'e','c') when case_id%4=1 then replace(name,' ','') when case_id%6=2 and config_id='b' then concat(name,'.') else name end name,
 case when case_id%7=0 then cast(cast(age as int)+3 as string) else age end age,
 case when case_id%9=0 then null when case_id%10=1 then replace(relation_name, 'Brand', 'Brond') else relation_name end relation_name, case when case_id%37=0 then 'Guardian' else relation_type end relation_type,
 case when case_id%12=0 then replace(house, '-', ' -') else house end house, case when case_id%41=0 and config_id='b' then null else gender end gender
 from fx_gold cross join (values ('a'),('b')) k(config_id)""",
}


class Frames(dict):
    """The views as lazy frames, keyed without the prefix; base tables keep their names.

    The view of register documents is documents_roll, the table of web pages pages_html. A frame and
    the views it needs are made when it is first asked for.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def _view(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                for needed in dict.fromkeys(re.findall(r"\b(?:from|join)\s+(\w+)", VIEWS[name])):
                    if needed in VIEWS or needed in TABLES:
                        self._view(needed)
                frame = self.spark.sql(re.sub(r"\b(from|join)\s+(\w+)", lambda m: f"{m[1]} {PREFIX}{m[2]}" if m[2] in VIEWS or m[2] in TABLES else m[0], VIEWS[name]))
            else:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            frame.createOrReplaceTempView(PREFIX + name)
            self.made[name] = frame
        return self.made[name]

    def __missing__(self, key: str) -> DataFrame:
        special = {"documents": "documents", "documents_roll": "fx_documents", "pages_html": "pages"}
        self[key] = self._view(special.get(key, f"fx_{key}" if f"fx_{key}" in VIEWS else key))
        return self[key]


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    return Frames(spark, sf_dir)


def oracle(sql: str) -> str:
    """A query text over the views, with them as common table expressions."""
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in VIEWS.items()) + (",\n" + sql[5:] if sql.lstrip().lower().startswith("with ") else "\n" + sql)
