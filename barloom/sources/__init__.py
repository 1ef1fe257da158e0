"""Readers and writers: bar files in several layouts, kline rows, ticks."""
