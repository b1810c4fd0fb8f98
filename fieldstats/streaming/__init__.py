"""The period aggregation over a stream."""
