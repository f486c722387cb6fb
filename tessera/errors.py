"""What lookups raise."""


class MediaError(Exception):
    """Base of all errors about media."""


class MediaNotFound(MediaError):
    pass


class FolderNotFound(MediaError):
    pass


class AccessDenied(MediaError):
    pass


class ExternalServiceError(MediaError):
    pass


class FeatureUnavailable(MediaError):
    """A feature whose source doesn't answer."""


class BookmarkError(MediaError):
    pass


class BookmarkNotFound(BookmarkError):
    pass
