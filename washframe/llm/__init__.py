"""Operations of a large-scale training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it. Each operator module states its
contract for nulls, empty inputs, repeated rows and ties in its docstring;
``queries`` registers one whole-table query per operator.
"""
