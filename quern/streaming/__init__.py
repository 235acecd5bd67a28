"""No job of this library reads a stream yet."""
