"""Samplers, partition statistics, the partition join graph, estimators and accuracy reports."""
