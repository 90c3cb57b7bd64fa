import os
import httpx

BASE = os.getenv("BASE_URL")


def ping():
    httpx.post("https://hooks.example.org:8443/x")
    requests.request("PUT", "https://put.example.org/y")
    httpx.get("/relative")  # FIXME later
