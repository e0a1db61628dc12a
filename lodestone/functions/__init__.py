"""Scalar functions on compositions, arrays and spectra."""
