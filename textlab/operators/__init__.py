"""DataFrame operators: corpus construction, pairing, evaluation, coverage, layout, grids and reports."""
