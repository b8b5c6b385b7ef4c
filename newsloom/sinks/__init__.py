"""Writers of the archive and of the analytics table."""
