"""Session, storage and table helpers shared by every part of the library."""
