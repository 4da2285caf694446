"""The registered queries and their SQL."""

from __future__ import annotations

from . import evidence_queries, identity_queries, label_queries, metric_queries, more_queries, note_queries, record_queries, report_queries, skill_queries, text_queries, vendor_queries

QUERIES = {**metric_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES, **report_queries.QUERIES, **identity_queries.QUERIES, **vendor_queries.QUERIES, **label_queries.QUERIES, **skill_queries.QUERIES, **record_queries.QUERIES, **evidence_queries.QUERIES, **note_queries.QUERIES}
SQL = {**metric_queries.SQL, **text_queries.SQL, **more_queries.SQL, **report_queries.SQL, **identity_queries.SQL, **vendor_queries.SQL, **label_queries.SQL, **skill_queries.SQL, **record_queries.SQL, **evidence_queries.SQL, **note_queries.SQL}
