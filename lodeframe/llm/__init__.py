"""Operators for preparing training text at corpus scale.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; :mod:`lodeframe.llm.queries` registers one thin query per
operator.
"""
