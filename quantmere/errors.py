"""Errors of sources and stores."""


class QuantmereError(Exception):
    """Base of all errors of this package."""


class AuthError(QuantmereError):
    pass


class QuotaError(QuantmereError):
    pass


class NotFoundError(QuantmereError, KeyError):
    pass


class AmbiguousError(QuantmereError):
    pass


class TransientError(QuantmereError):
    pass


class MalformedDataError(QuantmereError, ValueError):
    pass


class ReadOnlyError(QuantmereError):
    pass
