"""Scalar functions: JVM expressions where Spark has them, Arrow batches where it has not."""
