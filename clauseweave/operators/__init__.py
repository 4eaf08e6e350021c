"""Relational operators over clause, prediction and embedding tables."""

# A note on explodes: for a plain explode Spark adds a "not empty" filter below
# it. When the exploded array is itself costly (segmentation, tokenising) that
# filter computes it again, before any repartitioning. The operators therefore
# use the outer form and drop the null row afterwards.
