"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, names its id and text columns by parameter, and leaves columns that
it does not know alone or drops them, as its docstring says.
"""
