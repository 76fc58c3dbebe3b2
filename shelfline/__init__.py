"""Retail-chain analytics as Spark DataFrame operators.

``sources``    canonical tables: schemas, readers, writers, the adapter for the test tables
``functions``  reusable column expressions and relational building blocks
``operators``  data-quality audit, business queries, exploration, A/B test, star schema, loads, KPIs
``streaming``  the hourly feed: ingest, de-duplication, late rows, weekly totals
``plans``      the registered queries and the SQL they are checked against
"""
