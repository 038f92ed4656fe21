"""The three entry points: onboard a dataset, build a mart, run read-only SQL."""
