"""A reactive fact engine on Spark: LWW facts, hybrid clocks, watch graphs and rule cascades."""
