"""Package images and request documents in; packages and files out."""
