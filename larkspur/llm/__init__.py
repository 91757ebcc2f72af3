"""Training-data operators: ten corpus operations behind thin ``opN_`` queries.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns a DataFrame; intermediate tables go to the folder named by
``spark.checkpoint.dir`` (see :mod:`larkspur.llm.scratch`).
"""
