"""One exception class for each cause of a refusal; messages name the object and a remedy."""


class EngineError(Exception):
    """Base of all refusals."""


class ParseError(EngineError):
    """The text is not a statement of the grammar."""


class BindError(EngineError):
    """A name or a type does not fit."""


class ConstraintError(EngineError):
    """A write would break NOT NULL, a VARCHAR's length or the key."""


class EvaluationError(EngineError):
    """A value cannot be computed."""


class TransactionError(EngineError):
    """Conflicting or misplaced transaction work."""


class BranchError(EngineError):
    """A branch does not exist, is stale or is in the wrong state."""


class MergeError(EngineError):
    """Operations that cannot be merged at all."""


class EscrowError(EngineError):
    """A bounded counter's budget does not allow a claim or a spend."""


class ProvenanceError(EngineError):
    """Authorship that contradicts what is recorded."""


class FeedError(EngineError):
    """A change feed that is malformed or not in order."""
