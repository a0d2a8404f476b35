"""Domain profiles: canonical table in, one wide feature row and verdict per object out."""
