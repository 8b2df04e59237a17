"""Errors that callers tell apart."""


class SluiceError(Exception):
    """Any refusal by this package."""


class AdmissionError(SluiceError):
    """An expression or statement outside the admitted language."""


class ContractError(SluiceError):
    """A contract that cannot be compiled, or a run that it rejects."""


class SchemaError(SluiceError):
    """Schemas that do not fit each other."""


class DeliveryError(SluiceError):
    """A load that a destination must not take."""


class PositionError(SluiceError):
    """Source positions or watermarks that cannot be combined."""
