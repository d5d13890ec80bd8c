"""Errors: raised when a plan is built, or named in a status column where only the data can tell."""

from __future__ import annotations


class DistributionError(ValueError):
    """Base of all errors here."""


class MaxPowerTooHigh(DistributionError):
    """The largest value's power is above 64."""


class MaxPowerTooLow(DistributionError):
    """The largest value's power is not above the grouping power."""


class InvalidPercentile(DistributionError):
    """A percentile is not in 0 to 100."""


class InvalidQuantile(DistributionError):
    """A quantile is not in 0 to 1."""


class OutOfRange(DistributionError):
    """A value or bucket index is beyond the configuration's range."""


class IncompatibleParameters(DistributionError):
    """Configurations or lengths do not go together."""


class Overflow(DistributionError):
    """A counter passes its width."""


class Underflow(DistributionError):
    """A counter falls below zero."""


class InvalidSubset(DistributionError):
    """The right side of a subtraction has a bucket that the left side lacks."""
