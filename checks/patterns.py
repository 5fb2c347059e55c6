"""Text patterns of the SQL twins, written out here so that a wrong one in the library shows."""

SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
TAG = "<[^>]+>"
LINK = r"http[^\t-\r\x1c-\x1f\x85\p{Z}]+|www\.[^\t-\r\x1c-\x1f\x85\p{Z}]+"
MAIL = r"[^\t-\r\x1c-\x1f\x85\p{Z}]+@[^\t-\r\x1c-\x1f\x85\p{Z}]+"
DIGIT = r"\p{Nd}"
SPECIAL = r"[^a-zA-Z0-9\t-\r\x1c-\x1f\x85\p{Z}]"
