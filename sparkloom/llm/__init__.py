"""Training-data operators: each takes DataFrames and returns DataFrames.

Conventions that hold for all of them: a null text counts as empty, unless an operator says otherwise;
working columns start with ``__``, so columns of the input may have any other name.
"""
