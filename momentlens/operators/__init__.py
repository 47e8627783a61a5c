"""DataFrame operators over signals, series, intervals, vectors, manifests and timelines."""
