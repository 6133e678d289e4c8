"""Source jobs: files in a landing folder become readings or headlines."""
