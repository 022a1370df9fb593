"""Refusals: each names what was wrong instead of letting a silent default through."""


class ContractError(ValueError):
    """A table breaks its contract."""


class ConfigError(ValueError):
    """A configuration is incoherent."""


class MissingScoreError(ValueError):
    """A document without a score was to be ordered."""


class UniverseError(ValueError):
    """A run and a universe do not fit."""


class AllocationError(ValueError):
    """A budget cannot be spent as asked."""


class InputError(ValueError):
    """Inputs disagree with each other."""


class PassageError(LookupError):
    """A text is missing."""


class ListwiseScorerError(TypeError):
    """A listwise scorer would change what is being estimated."""


class ConflictError(ValueError):
    """Several sources say different things of one key."""
