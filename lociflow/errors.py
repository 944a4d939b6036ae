"""Errors of the engine."""

from __future__ import annotations


class LociflowError(Exception):
    """Base of all errors here."""


class InvalidThresholdError(LociflowError, ValueError):
    """A threshold outside its range."""


class EmptyLocusSetError(LociflowError, ValueError):
    """No locus or no sample is left."""


class AlignmentError(LociflowError):
    """An alignment that can't be read."""


class PopulationMapError(LociflowError, KeyError):
    """Samples and population map don't fit."""


class AlleleEncodingError(LociflowError, ValueError):
    """Alleles outside the encoding."""


class ConfigurationError(LociflowError, ValueError):
    """Options that contradict each other."""


class InsufficientDataError(LociflowError, RuntimeError):
    """Too little data for a statistic."""
