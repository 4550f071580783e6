"""Scalar functions as Column expressions (JVM-side, whole-stage codegen)."""
