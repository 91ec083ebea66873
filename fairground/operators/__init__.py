"""DataFrame operators: DataFrame in, DataFrame out, lazy unless the docstring says otherwise."""
