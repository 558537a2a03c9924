"""Traffic-signal telemetry analytics on Spark: decode, change detection, pairing rules, schedules and clip planning."""
