"""All registered queries and their SQL."""

from verification import queries_bars, queries_models, queries_reports
from verification import sql_bars, sql_models, sql_reports

QUERIES = {**queries_bars.QUERIES, **queries_reports.QUERIES, **queries_models.QUERIES}
SQL = {**sql_bars.SQL, **sql_reports.SQL, **sql_models.SQL}
