"""panelspark: panel-data, index-number and corpus analytics as Spark DataFrame plans.

Layout
------
functions/  Column -> Column helpers (R-style IEEE log/division, three-way if-else,
            numeric coercion, token pattern, ordered levels).
sources/    scans and sinks (parquet tables, headered / headerless / fixed-width text,
            nested series, corpus, stopword tables, shared working folders).
operators/  DataFrame -> DataFrame operators (panel time operators, relational helpers,
            reshaping, text statistics, topic models).
plans/      the end-to-end analyses (trade decomposition, crime panel, corpus statistics)
            and the fixture builders that derive their inputs from the test tables.
"""

from panelspark.session import local_session, materialize, shared_path

__all__ = ["local_session", "materialize", "shared_path"]
