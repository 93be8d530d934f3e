"""quillmark.streaming"""
