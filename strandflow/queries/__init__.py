"""All queries of the pileup engine and their SQL twins."""

from . import calling, pileup, records, tables

QUERIES = pileup.QUERIES | tables.QUERIES | calling.QUERIES | records.QUERIES
SQL = pileup.SQL | tables.SQL | calling.SQL | records.SQL
