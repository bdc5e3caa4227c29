"""DataFrame operators: joins, intervals, windows, sampling, reshaping."""
