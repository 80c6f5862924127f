"""DataFrame-to-DataFrame operators over words, segments, turns, vectors and flags."""
